"""Exact statistics of live facts: category counts and selectivity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def category_counts(current: DataFrame) -> DataFrame:
    return current.groupBy("category").agg(F.count("*").alias("n"))


def selectivity(current: DataFrame, category: int) -> DataFrame:
    """(n, total, selectivity): null for an empty table, 0 for a category not met."""
    n = F.count(F.when(F.col("category") == category, 1))
    return current.agg(n.alias("n"), F.count("*").alias("total"), (n / F.nullif(F.count("*"), F.lit(0))).alias("selectivity"))
