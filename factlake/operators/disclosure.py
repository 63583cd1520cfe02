"""Staged results: a small summary first, the pinned rows on request, both with token costs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.codecs import grain_tokens
from ..storage import shared_path

#: Fixed value: tokens of a summary besides its representatives.
SUMMARY_TOKENS = 16
#: Fixed value: results that stay pinned; the oldest go first.
CAPACITY = 4096


def ranked(result: DataFrame) -> DataFrame:
    """``result`` (dist, sid, val_bytes, ...) with rank from 0 and tokens. A result has k rows."""
    order = Window.orderBy("dist", "sid")
    return result.withColumn("rank", (F.row_number().over(order) - 1).cast("long")).withColumn("tokens", grain_tokens(F.col("val_bytes")))


def representatives(pinned: DataFrame, reps: int) -> DataFrame:
    """The first row of each band: the rows are cut into bands of ceil(n / min(reps, n)), so there
    may be fewer than ``reps``."""
    return pinned.withColumn("_shown", shown(reps)).where("_shown").drop("_shown")


def shown(reps: int) -> Column:
    """Whether a ranked row is a representative."""
    n = F.count("*").over(Window.partitionBy())
    return F.col("rank") % F.ceil(n / F.least(F.greatest(F.lit(reps), F.lit(1)), n)) == 0


def summary(pinned: DataFrame, reps: int) -> DataFrame:
    """One row: count, least, upper median and greatest dist, sharpness, tokens of stage 0 and 1.

    Sharpness is the gap between the two best over the whole range, 1 for fewer than two rows; an
    empty result has zeros.
    """
    tokens = F.coalesce(F.sum("tokens"), F.lit(0)).alias("full_tokens")
    few = F.coalesce(F.sum(F.when(F.col("_shown"), F.col("tokens"))), F.lit(0)).alias("shown")
    whole = pinned.withColumn("_shown", shown(reps)).agg(F.sort_array(F.collect_list("dist")).alias("d"), tokens, few)
    n, d = F.size("d"), F.col("d")

    def at(i):
        return F.coalesce(F.get(d, i), F.lit(0.0))

    gap = (at(F.lit(1)) - at(F.lit(0))) / F.greatest(at(n - 1) - at(F.lit(0)), F.lit(1e-6))
    return whole.select(
        n.cast("long").alias("n"),
        at(F.lit(0)).alias("dist_min"),
        at(F.floor(n / 2).cast("int")).alias("dist_median"),
        at(n - 1).alias("dist_max"),
        F.when(n < 2, F.lit(1.0)).otherwise(F.least(F.greatest(gap, F.lit(0.0)), F.lit(1.0))).alias("sharpness"),
        (F.col("shown") + SUMMARY_TOKENS).cast("long").alias("stage0_tokens"),
        F.col("full_tokens").cast("long").alias("full_tokens"),
    )


class Continuations:
    """Pinned results by handle, in files: what was ranked at stage 0 is what stage 1 reads."""

    def __init__(self, spark: SparkSession, path: str | None = None, capacity: int = CAPACITY):
        self.spark, self.capacity = spark, max(capacity, 1)
        self.path = path or shared_path(spark, "continuations")
        self.handles: list[int] = []
        self.last = 0

    def pin(self, rows: DataFrame) -> int:
        """Writes the ranked rows; returns their handle. Beyond the capacity the oldest goes."""
        self.last += 1
        rows.write.parquet(f"{self.path}/handle={self.last}")
        self.handles.append(self.last)
        while len(self.handles) > self.capacity:
            self.forget(self.handles.pop(0))
        return self.last

    def drill(self, handle: int) -> DataFrame | None:
        """The pinned rows, or None for an unknown or evicted handle; nothing is searched again."""
        return self.spark.read.parquet(f"{self.path}/handle={handle}") if handle in self.handles else None

    def forget(self, handle: int) -> None:
        jvm = self.spark.sparkContext._jvm
        place = jvm.org.apache.hadoop.fs.Path(f"{self.path}/handle={handle}")
        place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def evict(handles: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Handles that stay: the newest ``capacity``."""
    return handles.orderBy(F.col("handle").desc()).limit(capacity)
