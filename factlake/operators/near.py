"""The hybrid query: nearest facts that also meet a predicate, ranked.

Exact mode filters, then measures, so recall is 1. Post-filter mode takes k * over_fetch
candidates by distance first, joins them with the facts, then filters: what an approximate index
would serve, short when few candidates meet the predicate.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.codecs import header_byte
from ..storage import sized_join
from . import knn


def filter_any() -> Column:
    return F.lit(True)


def filter_header_eq(value: str, offset: int, byte: int) -> Column:
    """The byte at an offset of a binary column; false past the end and for tombstones."""
    return F.coalesce(header_byte(F.col(value), offset) == byte, F.lit(False))


def filter_store(category: int | None = None, at_least: int | None = None, at_most: int | None = None) -> Column:
    """Optional category and inclusive bounds of the amount."""
    out = F.lit(True)
    for given, test in ((category, F.col("category") == category), (at_least, F.col("amount") >= at_least), (at_most, F.col("amount") <= at_most)):
        if given is not None:
            out &= test
    return out


def near_select(facts: DataFrame, query: Sequence[float], k: int, where: Column | None = None, pred: int = 0) -> DataFrame:
    """Exact: ``facts`` of one attribute, at one snapshot, with dist."""
    return knn.nearest(facts.where(F.col("pred") == pred), query, k, where)


def near_select_postfilter(vectors: DataFrame, facts: DataFrame, query: Sequence[float], k: int, over_fetch: int, where: Column, pred: int = 0) -> DataFrame:
    """Candidates from ``vectors``, values from ``facts``; k * over_fetch candidates at most."""
    fetched = max(k * max(over_fetch, 1), k)
    candidates = knn.nearest(vectors.where(F.col("pred") == pred), query, fetched).select("sid", "dist")
    return with_values(candidates, facts.where(F.col("pred") == pred), k, where, fetched)


def with_values(candidates: DataFrame, facts: DataFrame, k: int, where: Column, fetched: int) -> DataFrame:
    """The k nearest of ``candidates`` (sid, dist), ``fetched`` at most, that are facts and meet ``where``."""
    joined = sized_join(facts, candidates, "sid", fetched)
    return joined.where(where).orderBy("dist", "sid").limit(k)
