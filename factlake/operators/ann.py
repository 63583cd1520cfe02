"""Approximate strategies: inverted file on blocks, and random-projection hashing.

They trade recall for rows scanned; both are reported, and exact search stays the default.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml.feature import BucketedRandomProjectionLSH
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.distance import l2_sq_to
from . import blocks, knn


def ivf(block_rows: DataFrame, centres: DataFrame, query: Sequence[float], k: int, probes: int) -> DataFrame:
    """The k nearest within the ``probes`` blocks whose centres (one row per block) are nearest."""
    d = l2_sq_to(F.col("centroid"), query)
    chosen = [r["block_id"] for r in centres.orderBy(d, "block_id").limit(probes).select("block_id").collect()]
    return knn.nearest(block_rows.where(F.col("block_id").isin(chosen)), query, k)


def ivf_batch(block_rows: DataFrame, centres: DataFrame, queries: DataFrame, k: int, probes: int) -> DataFrame:
    """(query_id, sid, dist, place) for every query (query_id, vector): the k nearest within the
    ``probes`` blocks nearest to it. Centres, one row per block, and BROADCAST_ROWS queries at once
    go to every executor; a block's rows meet the queries that probe it."""
    cells = centres.orderBy("block_id").toPandas()
    return knn.best(reduce(DataFrame.union, [_probe(block_rows, cells, queries, block, k, probes) for block in knn.query_sets(queries)]), k)


def _probe(block_rows: DataFrame, cells: pd.DataFrame, queries: DataFrame, block: tuple[np.ndarray, np.ndarray], k: int, probes: int) -> DataFrame:
    names, asked = block
    middles = np.stack(cells["centroid"].to_numpy()) if len(cells) and len(names) else np.empty((0, asked.shape[1]))
    far = (asked**2).sum(1)[:, None] - 2 * asked @ middles.T + (middles**2).sum(1)
    probed = np.argsort(far, axis=1, kind="stable")[:, :probes]
    by_block = {int(b): np.flatnonzero((probed == i).any(1)) for i, b in enumerate(cells["block_id"])}
    sent = block_rows.sparkSession.sparkContext.broadcast((names, asked, by_block))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, asked, by_block = sent.value
        for batch in batches:
            for block, rows in batch.groupby("block_id"):
                own = by_block[int(block)]
                yield from knn.closest(names[own], asked[own], rows["sid"].to_numpy(), np.stack(rows["embedding"].to_numpy()).astype(np.float64), k)

    fitting = block_rows.where(F.size("embedding") == asked.shape[1]).select("block_id", "sid", "embedding")
    return fitting.mapInPandas(run, f"query_id {dict(queries.dtypes)['query_id']}, sid bigint, dist double")


def build_ivf(grains: DataFrame, cells: int, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """(rows with block_id, centres)."""
    rows = blocks.assign_kmeans(grains, cells, seed=seed)
    return rows, blocks.centroids(rows)


def lsh(grains: DataFrame, query: Sequence[float], k: int, bucket: float = 0.5, tables: int = 8, seed: int = 1) -> DataFrame:
    """The k nearest among rows that share a bucket with the query; (sid, dist)."""
    fed = grains.withColumn("_v", array_to_vector(F.col("embedding").cast("array<double>")))
    model = BucketedRandomProjectionLSH(inputCol="_v", outputCol="_h", bucketLength=bucket, numHashTables=tables, seed=seed).fit(fed)
    found = model.approxNearestNeighbors(fed, Vectors.dense([float(x) for x in query]), k)
    return found.select("sid", (F.col("distCol") * F.col("distCol")).alias("dist"))
