"""Facts as views of the driver's tables, the same rows in each run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import read

#: Token bytes of a vector fact: one header byte and 64 floats.
VECTOR_BYTES = 1 + 4 * 64
LANGS = ("de", "en", "es", "fr")
PREDS = ("signup", "view", "click", "purchase")


def grains_vec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One vector fact per embedding: sid, pred 0, category, embedding, seq, c, val_bytes."""
    table = read(spark, sf_dir, "embeddings")
    return table.select(
        F.col("vec_id").alias("sid"),
        F.lit(0).cast("long").alias("pred"),
        F.col("label").alias("category"),
        "embedding",
        (F.col("vec_id") + 1).alias("seq"),
        F.lit(1.0).cast("float").alias("c"),
        F.lit(VECTOR_BYTES).cast("long").alias("val_bytes"),
    )


def query_vector(spark: SparkSession, sf_dir: str, vec_id: int = 0) -> list[float]:
    """The embedding of one row, as a query."""
    row = read(spark, sf_dir, "embeddings").where(F.col("vec_id") == vec_id).select("embedding").first()
    return list(row["embedding"]) if row else []


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a timestamp without zone, taken as UTC."""
    zoned = F.convert_timezone(F.lit("UTC"), F.current_timezone(), ts.cast("timestamp_ntz"))
    return F.unix_micros(zoned.cast("timestamp"))


def log_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log from ``events``: the type is the attribute, an error deletes attribute event_id % 4."""
    table = read(spark, sf_dir, "events")
    kind = F.col("event_type")
    pred = F.col("event_id") % 4
    for i, name in reversed(list(enumerate(PREDS))):
        pred = F.when(kind == name, F.lit(i).cast("long")).otherwise(pred)
    gone = kind == "error"
    return table.select(
        (F.col("event_id") + 1).alias("seq"),
        F.col("user_id").alias("sid"),
        pred.cast("long").alias("pred"),
        F.when(gone, F.lit(1)).otherwise(F.lit(0)).cast("smallint").alias("op"),
        F.when(~gone, F.col("props")).alias("val"),
        F.least(F.col("value") / 500, F.lit(1.0)).alias("c"),
        micros(F.col("ts")).alias("t_valid"),
        F.col("event_id").alias("idem_key"),
    )


def log_arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes in order of arrival, before commit: every tenth is sent again, later and changed."""
    log = log_events(spark, sf_dir).withColumn("arrival", F.col("idem_key")).drop("seq")
    again = log.where(F.col("idem_key") % 10 == 0)
    changed = F.when(F.col("op") == 0, F.concat(F.col("val"), F.lit("!")))
    return log.unionByName(again.withColumns({"arrival": F.col("arrival") + 10**9, "val": changed}))


def probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sid, pred, snapshot): every known pair at a quarter, half and all of the log."""
    log = log_events(spark, sf_dir)
    n = log.agg(F.max("seq")).first()[0] or 0
    snapshots = F.explode(F.array(*[F.lit(x).cast("long") for x in (n // 4, n // 2, n)])).alias("snapshot")
    return log.select("sid", "pred").distinct().select("sid", "pred", snapshots)


def grains_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text facts from ``documents``: sid, category (index of the language), amount, text."""
    category = F.array_position(F.array(*[F.lit(x) for x in LANGS]), F.col("lang")).cast("int") - 1
    return read(spark, sf_dir, "documents").select(F.col("doc_id").alias("sid"), category.alias("category"), F.col("n_chars").alias("amount"), "text")


#: rule_id, agent, action (None: any), effect, match_kind, match_value
RULE_ROWS = [
    (0, 1, "read", "allow", "any", None),
    (1, 1, "read", "deny", "category", 9),
    (2, 2, "read", "allow", "category", 0),
    (3, 3, "read", "mask", "category", 0),
    (4, 3, "read", "allow", "category", 1),
    (5, 4, None, "allow", "pred", 0),
    (6, 4, "write", "deny", "category", 5),
]


def rules(spark: SparkSession) -> DataFrame:
    from ..schema import RULES

    return spark.createDataFrame(RULE_ROWS, RULES)


#: agent, seq, cost
QUERY_ROWS = [(1, 0, 160), (1, 1, 160), (1, 2, 30), (2, 0, 72), (2, 1, 144), (2, 2, 56), (3, 0, 500)]


def query_log(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(QUERY_ROWS, "agent bigint, seq bigint, cost bigint")


def grains_clustered(spark: SparkSession, n: int = 20_000, centres: int = 100, dim: int = 32) -> DataFrame:
    """Vectors near latent centres, by arithmetic on ids only; category is sid % 4."""
    sid = F.col("sid")

    def unit(seed: Column) -> Column:
        return F.pmod(F.xxhash64(seed), F.lit(10_000)) / 10_000.0

    place = F.transform(
        F.sequence(F.lit(0), F.lit(dim - 1)),
        lambda i: (unit((sid % centres) * 1000 + i) + (unit(sid * 1000 + i + 10**9) - 0.5) * 0.15).cast("float"),
    )
    return spark.range(n).withColumnRenamed("id", "sid").select(
        "sid",
        F.lit(0).cast("long").alias("pred"),
        (sid % 4).cast("int").alias("category"),
        place.alias("embedding"),
        (sid + 1).alias("seq"),
        F.lit(1.0).cast("float").alias("c"),
        F.lit(1 + 4 * dim).cast("long").alias("val_bytes"),
    )
