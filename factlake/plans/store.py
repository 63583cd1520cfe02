"""The text store: facts of text with a category and an amount, queried by meaning."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.codecs import encode_store_value
from ..functions.embed import embed, embed_text
from ..operators import knn, mvcc, near
from ..schema import PUT
from ..sources.log import FactLog

TEXTS = "seq bigint, sid bigint, pred bigint, op smallint, category int, amount bigint, text string, embedding array<float>, idem_key bigint, val_bytes bigint"
DIM = 64


@dataclass(frozen=True)
class Loaded:
    """Rows given, and rows that were new."""

    given: int
    new: int


def facts_of(texts: DataFrame, dim: int = DIM) -> DataFrame:
    """Rows (sid, category, amount, text) as writes: pred 0, idem_key = sid, with embedding."""
    size = F.octet_length(encode_store_value(F.col("category"), F.col("amount"), F.col("text")))
    return texts.select(
        "sid",
        F.lit(0).cast("long").alias("pred"),
        F.lit(PUT).cast("smallint").alias("op"),
        "category",
        "amount",
        "text",
        embed_text(F.col("text"), dim).alias("embedding"),
        F.col("sid").alias("idem_key"),
        size.cast("long").alias("val_bytes"),
    )


def hits(facts: DataFrame, text: str, k: int, category: int | None = None, at_least: int | None = None, at_most: int | None = None, dim: int = DIM) -> DataFrame:
    """sid, category, amount, text, distance (squared) of the k nearest facts within the bounds."""
    found = near.near_select(facts, embed(text, dim).tolist(), k, near.filter_store(category, at_least, at_most))
    return found.select("sid", "category", "amount", "text", F.col("dist").alias("distance"))


class Store:
    """A sid is written once: loading it again changes nothing, unless ``upsert`` is asked for."""

    def __init__(self, spark: SparkSession, path: str, dim: int = DIM):
        self.spark, self.dim = spark, dim
        self.log = FactLog(spark, path, TEXTS)

    def load(self, texts: DataFrame, upsert: bool = False) -> Loaded:
        """Commits texts in order of sid; within a load the first of a sid counts."""
        facts = facts_of(texts, self.dim).withColumn("arrival", F.col("sid"))
        if upsert:
            facts = facts.withColumn("idem_key", F.lit(None).cast("long"))
        version = self.log.commit(facts)
        made = self.log.rows_of(self.log.commits().where(F.col("version") == version))
        return Loaded(texts.count(), made.join(texts.select("sid").distinct(), "sid", "left_semi").count())

    def is_healthy(self) -> bool:
        return self.log.is_healthy()

    def indexed(self) -> int:
        return knn.psi(self.log.read(), self.dim).count()

    def query(self, text: str, k: int = 5, category: int | None = None, at_least: int | None = None, at_most: int | None = None) -> DataFrame:
        return hits(mvcc.scan_live(self.log.read()), text, k, category, at_least, at_most, self.dim)
