"""Versions: newest, as of a snapshot, counts, ordered seeks.

Every read takes the log alone. Newest-per-key is a grouped arg-max with map-side combine, so a
hot key costs one row per task, not a sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import PUT

KEY = ("sid", "pred")


def newest(log: DataFrame, snapshot: Column | int | None = None) -> DataFrame:
    """The newest version of each (sid, pred), tombstones included, at or before the snapshot."""
    if snapshot is not None:
        log = log.where(F.col("seq") <= snapshot)
    rest = [c for c in log.columns if c not in KEY]
    best = log.groupBy(*KEY).agg(F.max_by(F.struct(*rest), "seq").alias("v"))
    return best.select(*KEY, "v.*").select(*log.columns)


def scan_live(log: DataFrame, snapshot: Column | int | None = None) -> DataFrame:
    """Newest versions that aren't tombstones: a delete hides the versions before it."""
    return newest(log, snapshot).where(F.col("op") == PUT)


def scan_live_by_rank(log: DataFrame) -> DataFrame:
    """``scan_live`` by row_number; sorts each key's versions, for when the rank is wanted too."""
    order = Window.partitionBy(*KEY).orderBy(F.col("seq").desc())
    ranked = log.withColumn("version_rank", F.row_number().over(order))
    return ranked.where((F.col("version_rank") == 1) & (F.col("op") == PUT)).drop("version_rank")


def get_at(log: DataFrame, sid: int, pred: int, snapshot: int | None = None) -> DataFrame:
    """The version of one (sid, pred) at a snapshot (None: now); no row if absent or deleted."""
    return scan_live(log.where((F.col("sid") == sid) & (F.col("pred") == pred)), snapshot)


def asof_join(log: DataFrame, probes: DataFrame, width: int = 1 << 16) -> DataFrame:
    """For each probe (sid, pred, snapshot) the live version at its snapshot; absent ones drop out.

    Versions and probes are put in order together within (sid, pred, span of ``width`` sequence
    numbers), and each span carries the newest version of the spans before it. So the work is
    linear in versions and probes, and a hot key is spread over its spans.
    """
    values = [c for c in log.columns if c not in KEY]
    version = F.struct(*values)
    span = F.floor(F.col("at") / width)
    facts = log.select(*KEY, F.col("seq").alias("at"), F.lit(0).alias("kind"), version.alias("v"))
    asked = probes.select(*KEY, F.col("snapshot").alias("at"), F.lit(1).alias("kind"), F.lit(None).cast(facts.schema["v"].dataType).alias("v"))
    both = facts.unionByName(asked).withColumn("span", span)
    ends = both.groupBy(*KEY, "span").agg(F.max_by("v", F.when(F.col("v").isNotNull(), F.col("at"))).alias("last"))
    earlier = Window.partitionBy(*KEY).orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(*KEY, "span", F.last("last", ignorenulls=True).over(earlier).alias("carried"))
    within = Window.partitionBy(*KEY, "span").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    seen = both.withColumn("seen", F.last("v", ignorenulls=True).over(within)).where("kind = 1")
    found = seen.join(carried, [*KEY, "span"]).select(*KEY, F.col("at").alias("snapshot"), F.coalesce("seen", "carried").alias("v"))
    return found.where(F.col("v.op") == PUT).select(*KEY, "snapshot", "v.*")


def version_count(log: DataFrame) -> DataFrame:
    """Versions of each (sid, pred), tombstones included."""
    return log.groupBy(*KEY).agg(F.count("*").alias("versions"))


def total_versions(log: DataFrame) -> DataFrame:
    return log.agg(F.count("*").alias("total"))


def high_watermark(log: DataFrame) -> DataFrame:
    """The newest sequence number, 0 for an empty log, and the next to give."""
    top = F.coalesce(F.max("seq"), F.lit(0).cast("long"))
    return log.agg(top.alias("high"), (top + 1).alias("next"))


def scan_all(log: DataFrame) -> DataFrame:
    """All versions in key order: sid, pred, newest first."""
    return log.orderBy("sid", "pred", F.col("seq").desc())


def seek_ge(log: DataFrame, sid: int, pred: int, seq: int) -> DataFrame:
    """The first version in key order at or after (sid, pred, seq), as newer ones come first."""
    s, p, q = F.col("sid"), F.col("pred"), F.col("seq")
    after = (s > sid) | ((s == sid) & ((p > pred) | ((p == pred) & (q <= seq))))
    return scan_all(log.where(after)).limit(1)


def contiguous_watermark(applied: DataFrame) -> DataFrame:
    """The largest n with 1 to n all applied, from distinct or repeated ``seq`` values.

    n is the least missing value less one: seq values whose successor is missing, the least of
    them, provided 1 is there. An equi-join, so no task sees all values.
    """
    seqs = applied.select("seq").where(F.col("seq") >= 1).distinct()
    following = seqs.select((F.col("seq") - 1).alias("seq"))
    nothing = F.lit(None).cast("long")
    ends = seqs.join(following, "seq", "left_anti").select(F.col("seq").alias("last"), nothing.alias("first"))
    both = ends.unionByName(seqs.select(nothing.alias("last"), F.col("seq").alias("first")))
    starts_at_one = F.coalesce(F.min("first") == 1, F.lit(False))
    return both.agg(F.when(starts_at_one, F.min("last")).otherwise(F.lit(0)).cast("long").alias("watermark"))
