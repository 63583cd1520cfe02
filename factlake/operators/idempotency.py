"""Idempotent writes: a key counts once, its first arrival wins, and later payloads are ignored."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_arrivals(batch: DataFrame, by: str = "arrival") -> DataFrame:
    """One row per idem_key, the first by ``by``; rows with a null key are all kept."""
    rest = [c for c in batch.columns if c != "idem_key"]
    keyed = batch.where(F.col("idem_key").isNotNull()).groupBy("idem_key").agg(F.min_by(F.struct(*rest), by).alias("v"))
    return keyed.select("idem_key", "v.*").select(*batch.columns).unionByName(batch.where(F.col("idem_key").isNull()))


def unseen(batch: DataFrame, committed: DataFrame, by: str = "arrival") -> DataFrame:
    """First arrivals whose key isn't in the log. Keys are one name space over all sids."""
    keys = committed.select("idem_key").where(F.col("idem_key").isNotNull()).distinct()
    return first_arrivals(batch, by).join(keys, "idem_key", "left_anti").select(*batch.columns)


def acknowledged(batch: DataFrame, committed: DataFrame) -> DataFrame:
    """Each row of a committed batch with the sequence of its key's first write, and whether it was new."""
    first = committed.groupBy("idem_key").agg(F.min("seq").alias("seq"))
    return batch.drop("seq").join(first, "idem_key", "left")


def replayed(log: DataFrame) -> DataFrame:
    """(idem_key, seq): what a restart remembers, the first write of each key."""
    return log.where(F.col("idem_key").isNotNull()).groupBy("idem_key").agg(F.min("seq").alias("seq"))
