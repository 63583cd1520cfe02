"""Self-describing blocks: clustered vectors with descriptors that let queries skip them."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..functions.distance import l2, l2_sq_to
from ..functions.hashing import bloom_build, bloom_contains, bloom_params, bloom_size
from ..storage import BROADCAST_ROWS, kept, sized_join

#: Fixed value: bands of confidence.
BUCKETS = 8


@dataclass(frozen=True)
class Stats:
    """What a query read: blocks touched, of all."""

    touched: int
    total: int


def assign_by(grains: DataFrame, column: str) -> DataFrame:
    """Blocks by the value of a column."""
    return grains.withColumn("block_id", F.col(column).cast("long"))


def assign_kmeans(grains: DataFrame, blocks: int, iters: int = 10, seed: int = 1) -> DataFrame:
    """Blocks by k-means. The assignment shapes how much is skipped, never what is found.

    An empty table has no blocks; the centres go to every executor, ``blocks`` of them.
    """
    fed = grains.withColumn("_v", array_to_vector(F.col("embedding").cast("array<double>")))
    if fed.isEmpty():
        return grains.withColumn("block_id", F.lit(None).cast("long"))
    model = KMeans(k=blocks, maxIter=iters, seed=seed, featuresCol="_v", predictionCol="_b").fit(fed)
    return model.transform(fed).withColumn("block_id", F.col("_b").cast("long")).drop("_v", "_b")


def centroids(blocks: DataFrame) -> DataFrame:
    """(block_id, centroid): element-wise mean, one running mean per block and task."""
    vector = array_to_vector(F.col("embedding").cast("array<double>"))
    return blocks.groupBy("block_id").agg(vector_to_array(Summarizer.mean(vector)).alias("centroid"))


def category_counts(blocks: DataFrame) -> DataFrame:
    return blocks.groupBy("block_id", "category").agg(F.count("*").alias("n"))


def confidence_histogram(blocks: DataFrame) -> DataFrame:
    """(block_id, bucket, n): confidence in eighths; below 0 counts as 0, 1 and above as 7."""
    c = F.col("c").cast("double")
    bucket = F.when(F.isnan(c), F.lit(0.0)).otherwise(F.least(F.greatest(F.floor(c * BUCKETS), F.lit(0)), F.lit(BUCKETS - 1))).cast("int")
    return blocks.groupBy("block_id", bucket.alias("bucket")).agg(F.count("*").alias("n"))


def zone_map(blocks: DataFrame) -> DataFrame:
    return blocks.groupBy("block_id").agg(F.min("seq").alias("t_min"), F.max("seq").alias("t_max"), F.count("*").alias("n"))


def descriptors(blocks: DataFrame) -> DataFrame:
    """One row per block: centroid, radius, preds, t_min, t_max, n, and Bloom sizes. Two reads of
    the blocks: the centres first, then the rest, with the centres, a row per block, beside it."""
    vector = array_to_vector(F.col("embedding").cast("array<double>"))
    one = kept(blocks.groupBy("block_id").agg(vector_to_array(Summarizer.mean(vector)).alias("centroid"), F.count("*").alias("n")))
    measured = sized_join(blocks.drop("n"), one, "block_id", one.count())
    out = measured.groupBy("block_id").agg(
        F.first("centroid").alias("centroid"),
        F.max(l2(F.col("embedding"), F.col("centroid"))).alias("radius"),
        F.sort_array(F.collect_set("pred")).alias("preds"),
        F.min("seq").alias("t_min"),
        F.max("seq").alias("t_max"),
        F.first("n").alias("n"),
    )
    bits, hashes = bloom_params(F.col("n"))
    return out.withColumns({"bloom_bits": bits, "bloom_hashes": hashes})


def blooms(blocks: DataFrame, p: float = 0.01) -> DataFrame:
    """(block_id, bloom, n): a Bloom filter of each block's sids, built from the parts of tasks.

    Sizes are set by the blocks' counts, so filters of parts can be joined by or.
    """
    counts = blocks.groupBy("block_id").agg(F.count("*").alias("n"))
    sized = blocks.select("block_id", "sid").join(counts, "block_id")

    def parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, tuple[np.ndarray, int]] = {}
        for batch in batches:
            for (block, n), rows in batch.groupby(["block_id", "n"]):
                bits, hashes = bloom_size(int(n), p)
                more = np.frombuffer(bloom_build(rows["sid"].to_numpy(), bits, hashes), dtype=np.uint8)
                was = held.get(block)
                held[block] = (more if was is None else was[0] | more, int(n))
        yield pd.DataFrame([(b, x.tobytes(), n) for b, (x, n) in held.items()], columns=["block_id", "part", "n"])

    def joined(rows: pd.DataFrame) -> pd.DataFrame:
        whole = np.bitwise_or.reduce([np.frombuffer(x, dtype=np.uint8) for x in rows["part"]])
        return pd.DataFrame([(rows["block_id"].iloc[0], whole.tobytes(), rows["n"].iloc[0])], columns=["block_id", "bloom", "n"])

    return sized.mapInPandas(parts, "block_id long, part binary, n long").groupBy("block_id").applyInPandas(joined, "block_id long, bloom binary, n long")


def may_hold(filters: DataFrame, sids: DataFrame | list[int]) -> DataFrame:
    """(sid, block_id) for each sid and each block whose filter (block_id, bloom, n) may hold it.

    Filters stay where they are; the sids go to them in blocks of BROADCAST_ROWS. Only hits come out.
    """
    if isinstance(sids, DataFrame):
        rows = (r["sid"] for r in sids.select("sid").toLocalIterator())
    else:
        rows = iter(sids)
    parts = []
    while not parts or len(keys) == BROADCAST_ROWS:
        keys = np.fromiter(islice(rows, BROADCAST_ROWS), np.int64)
        parts.append(_probe(filters, keys))
    return reduce(DataFrame.union, parts)


def _probe(filters: DataFrame, keys: np.ndarray, p: float = 0.01) -> DataFrame:
    sent = filters.sparkSession.sparkContext.broadcast(keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for block, bloom, n in zip(batch["block_id"], batch["bloom"], batch["n"], strict=True):
                hit = sent.value[bloom_contains(bloom, sent.value, *bloom_size(int(n), p))]
                yield pd.DataFrame({"sid": hit, "block_id": block})

    return filters.select("block_id", "bloom", "n").mapInPandas(run, "sid long, block_id long")


def get(blocks: DataFrame, filters: DataFrame, sid: int) -> tuple[DataFrame, Stats]:
    """Rows of one sid, from the blocks whose Bloom filter may hold it."""
    hit = [r["block_id"] for r in may_hold(filters, [sid]).collect()]
    return blocks.where(F.col("block_id").isin(hit) & (F.col("sid") == sid)), Stats(len(hit), filters.count())


def lower_bound(centroid, radius, query: Sequence[float]):
    """No member of a block is nearer than this (triangle inequality)."""
    return F.greatest(F.sqrt(l2_sq_to(centroid, query)) - radius, F.lit(0.0))


def surviving(described: DataFrame, query: Sequence[float], k: int) -> tuple[list[int], int]:
    """(blocks that may hold one of the k nearest, all blocks), from descriptors alone.

    The k-th distance is at most the least upper bound (centre distance + radius) by which blocks
    with k members in all are reached; blocks whose lower bound exceeds it are skipped.
    """
    d = F.sqrt(l2_sq_to(F.col("centroid"), query))
    rows = described.select("block_id", "n", (d + F.col("radius")).alias("high"), (d - F.col("radius")).alias("low")).orderBy("high").collect()
    seen, limit = 0, float("inf")
    for row in rows:
        seen += row["n"]
        if seen >= k:
            limit = row["high"] * (1 + 1e-12)
            break
    return [r["block_id"] for r in rows if r["low"] <= limit] if k > 0 else [], len(rows)


def touched(described: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, touched, total): how many blocks ``surviving`` leaves, for every query (query_id,
    vector) with its own id. One row per block goes to every executor."""
    d = l2(F.col("vector"), F.col("centroid"))
    each = queries.crossJoin(F.broadcast(described.select("centroid", "radius", F.col("n").alias("size"))))
    each = each.select("query_id", "size", (d + F.col("radius")).alias("high"), (d - F.col("radius")).alias("low"))
    reached = F.sum("size").over(Window.partitionBy("query_id").orderBy("high").rowsBetween(Window.unboundedPreceding, 0))
    each = each.withColumn("seen", reached)
    limit = F.min(F.when(F.col("seen") >= k, F.col("high") * (1 + 1e-12))).over(Window.partitionBy("query_id"))
    ended = each.withColumn("most", limit).groupBy("query_id")
    return ended.agg(F.count(F.when(F.col("most").isNull() | (F.col("low") <= F.col("most")), 1)).alias("touched"), F.count("*").alias("total"))


def near(blocks: DataFrame, described: DataFrame, query: Sequence[float], k: int) -> tuple[DataFrame, Stats]:
    """The exact k nearest (sid, dist, true distance), reading only surviving blocks."""
    hit, total = surviving(described, query, k)
    return _ranked(blocks.where(F.col("block_id").isin(hit)), query, k), Stats(len(hit), total)


def write(blocks: DataFrame, path: str) -> None:
    """Blocks as a layout on disk: ``rows`` partitioned by block_id, and the tables ``described``,
    ``blooms``, ``categories`` and ``confidence`` with a few rows per block. A block's rows lie in
    as many files as they need, and a reader that names blocks opens no other files."""
    spark = blocks.sparkSession
    rows = blocks.where(F.col("block_id").isNotNull())
    rows.repartition("block_id").write.partitionBy("block_id").parquet(f"{path}/rows")
    if rows.isEmpty():  # no folder of a block, so no schema
        rows.drop("block_id").withColumn("block_id", F.lit(0).cast("long")).limit(0).write.mode("overwrite").parquet(f"{path}/rows")
    stored = Stored(spark, path, rows.drop("block_id").schema).rows()
    descriptors(stored).write.parquet(f"{path}/described")
    blooms(stored).write.parquet(f"{path}/blooms")
    category_counts(stored).write.parquet(f"{path}/categories")
    confidence_histogram(stored).write.parquet(f"{path}/confidence")


class Stored:
    """Blocks that ``write`` laid out. What a query needn't read is decided by the small tables."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType | None = None):
        self.spark, self.path = spark, path
        self.schema = schema

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    def rows(self, ids: list[int] | None = None) -> DataFrame:
        """Rows of the named blocks, or of all; the filter prunes folders."""
        if self.schema is None:
            self.schema = StructType([f for f in self.table("rows").schema if f.name != "block_id"])
        schema = StructType([*self.schema.fields, StructField("block_id", LongType())])
        out = self.spark.read.schema(schema).parquet(f"{self.path}/rows")
        return out if ids is None else out.where(F.col("block_id").isin(ids))

    def described(self) -> DataFrame:
        return self.table("described")

    def nearest_blocks(self, query: Sequence[float], n: int) -> list[int]:
        """The n blocks whose centres are nearest."""
        d = l2_sq_to(F.col("centroid"), query)
        return [r["block_id"] for r in self.described().orderBy(d, "block_id").limit(n).select("block_id").collect()]

    def near(self, query: Sequence[float], k: int) -> tuple[DataFrame, Stats]:
        """The exact k nearest (sid, dist, true distance), reading only surviving blocks."""
        hit, total = surviving(self.described(), query, k)
        return _ranked(self.rows(hit), query, k), Stats(len(hit), total)

    def get(self, sid: int) -> tuple[DataFrame, Stats]:
        """Rows of one sid, from the blocks whose Bloom filter may hold it."""
        hit = [r["block_id"] for r in may_hold(self.table("blooms"), [sid]).collect()]
        return self.rows(hit).where(F.col("sid") == sid), Stats(len(hit), self.described().count())

    def count_category(self, category: int) -> DataFrame:
        return count_category(self.table("categories"), category)


def _ranked(rows: DataFrame, query: Sequence[float], k: int) -> DataFrame:
    rows = rows.where(F.size("embedding") == len(query))
    return rows.withColumn("dist", F.sqrt(l2_sq_to(F.col("embedding"), query))).orderBy("dist", "sid").limit(max(k, 0))


def count_category(counts: DataFrame, category: int) -> DataFrame:
    """Facts of a category, and blocks that hold any, from the blocks' counts alone."""
    n = F.coalesce(F.sum(F.when(F.col("category") == category, F.col("n"))), F.lit(0))
    touched = F.count_distinct(F.when(F.col("category") == category, F.col("block_id")))
    return counts.agg(n.cast("long").alias("n"), touched.alias("blocks_touched"), F.count_distinct("block_id").alias("blocks_total"))
