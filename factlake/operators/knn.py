"""Nearest neighbours: exact scans, shards, and many queries at once.

The vector view psi has the newest version of each (sid, pred); unembeddable ones have no row.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.distance import l2_sq_to
from ..functions.hashing import shard_of
from ..storage import BROADCAST_ROWS
from . import mvcc, sequence

#: Distances that one step of a matrix product makes.
BLOCK = 1 << 22


def psi(log: DataFrame, dim: int, snapshot: int | None = None) -> DataFrame:
    """Vectors of the newest versions; a newest version without a vector of ``dim`` has no row."""
    return mvcc.scan_live(log, snapshot).where(F.size("embedding") == dim)


def with_distance(vectors: DataFrame, query: Sequence[float]) -> DataFrame:
    """Rows of the query's length, with dist, the squared distance."""
    return vectors.where(F.size("embedding") == len(query)).withColumn("dist", l2_sq_to(F.col("embedding"), query))


def nearest(vectors: DataFrame, query: Sequence[float], k: int, where: Column | None = None) -> DataFrame:
    """The k nearest rows that meet ``where``, by dist then sid. The filter comes first, so the
    result is exact and never short; each partition keeps k rows and k per partition are merged."""
    if where is not None:
        vectors = vectors.where(where)
    return with_distance(vectors, query).orderBy("dist", "sid").limit(max(k, 0))


def nearest_by_shard(vectors: DataFrame, query: Sequence[float], k: int, shards: int) -> DataFrame:
    """``nearest`` through a top k of each shard, then of their union."""
    routed = with_distance(vectors, query).withColumn("shard", shard_of(F.col("sid"), shards))
    order = Window.partitionBy("shard").orderBy("dist", "sid")
    local = routed.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)
    return local.drop("place", "shard").orderBy("dist", "sid").limit(k)


def closest(names: np.ndarray, asked: np.ndarray, sids: np.ndarray, data: np.ndarray, k: int) -> Iterator[pd.DataFrame]:
    """For each query row of ``asked`` the k nearest rows of ``data``, and any level with the last.

    Candidates come from matrix products, a few million distances at a time; the distances of
    candidates are then exact sums of squares.
    """
    sizes, keep = (data**2).sum(1), min(k, len(data))
    step = max(1, BLOCK // max(len(data), 1))
    for at in range(0, len(names) if keep else 0, step):
        some, part = names[at : at + step], asked[at : at + step]
        rough = (part**2).sum(1)[:, None] - 2 * part @ data.T + sizes
        near = np.argpartition(rough, keep - 1, axis=1)[:, :keep]
        edge = np.take_along_axis(rough, near, 1).max(1)[:, None] + 1e-9 * (1 + sizes.max())
        q, v = np.nonzero(rough <= edge)
        yield pd.DataFrame({"query_id": some[q], "sid": sids[v], "dist": ((data[v] - part[q]) ** 2).sum(1)})


def query_sets(queries: DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and vectors of ``queries`` (query_id, vector) in blocks of BROADCAST_ROWS at most, as a
    block goes to every executor; one empty block without queries. One read of ``queries``, of
    which the driver holds a partition and a block."""
    rows, block = queries.select("query_id", "vector").toLocalIterator(), None
    while block is None or len(block) == BROADCAST_ROWS:
        last, block = block, list(islice(rows, BROADCAST_ROWS))
        if block or last is None:
            vectors = [np.asarray(r["vector"], dtype=np.float64) for r in block]
            yield np.array([r["query_id"] for r in block]), np.stack(vectors) if vectors else np.empty((0, 0))


def best(found: DataFrame, k: int) -> DataFrame:
    """The k best of each query with place; ranks are cut within tasks before the shuffle."""
    order = Window.partitionBy("query_id").orderBy("dist", "sid")
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def nearest_batch(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, sid, dist, place) of the k nearest for every query (query_id, vector).

    Each Arrow batch of vectors meets all queries of a block and keeps k candidates a query; the
    vectors are read once for each block of BROADCAST_ROWS queries.
    """
    return best(reduce(DataFrame.union, [_meet(vectors, queries, block, k) for block in query_sets(queries)]), k)


def _meet(vectors: DataFrame, queries: DataFrame, block: tuple[np.ndarray, np.ndarray], k: int) -> DataFrame:
    sent = vectors.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield from closest(*sent.value, batch["sid"].to_numpy(), np.stack(batch["embedding"].to_numpy()).astype(np.float64), k)

    fitting = vectors.where(F.size("embedding") == block[1].shape[1]).select("sid", "embedding")
    return fitting.mapInPandas(run, f"query_id {dict(queries.dtypes)['query_id']}, sid bigint, dist double")


def recall(exact: DataFrame, got: DataFrame, k: int) -> DataFrame:
    """(query_id, recall): share of the exact k that ``got`` has."""
    want = exact.groupBy("query_id").agg(F.collect_set("sid").alias("want"))
    have = got.groupBy("query_id").agg(F.collect_set("sid").alias("have"))
    hits = F.size(F.array_intersect("want", F.coalesce("have", F.array().cast("array<bigint>"))))
    return want.join(have, "query_id", "left").select("query_id", (hits / k).alias("recall"))


def percentile(values: DataFrame, column: str, p: float) -> DataFrame:
    """(value): the nearest-rank percentile, the value at place round(p / 100 * (n - 1)) of the
    ordered ones, halves up; 0 without values. Equal values are counted together, so the ranks
    are over distinct values."""
    counted = values.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    n = counted.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    ranked = sequence.running(counted, "value", "n")
    found = ranked.where(F.col("upto") > int(p / 100 * (n - 1) + 0.5)).agg(F.min("value").alias("value"))
    return found.select(F.coalesce("value", F.lit(0)).alias("value"))
