"""Approximate search by layered neighbour graphs, one per shard of the vectors.

A shard's graph is built in bulk: each layer has the nodes whose drawn level reaches it, each linked
to its nearest ones there and back, the nearest links kept. A search goes down from the top layer to
the nearest node of each, then follows links in the lowest layer with a beam of ``ef`` nodes. Shards
are searched side by side and their best are merged.
"""

from __future__ import annotations

import heapq
import io
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import shard_of
from . import knn

#: Links per node above the lowest layer and in it, the seed of the level draw, and
#: the factor and increment of its generator.
LINKS, LOWEST_LINKS, SEED = 16, 32, 0x123456789ABCDEF0
FACTOR, INCREMENT = 6364136223846793005, 1442695040888963407

#: Vectors of one shard, about: what one task builds in memory.
SHARD_ROWS = 4096

SCHEMA = "shard bigint, n bigint, graph binary"


def drawn_levels(n: int, links: int = LINKS, seed: int = SEED) -> np.ndarray:
    """Levels of n nodes: the whole part of -ln(u) / ln(links), u drawn by a linear generator."""
    out, state = np.empty(n, np.int64), seed
    for i in range(n):
        state = (state * FACTOR + INCREMENT) % 2**64
        out[i] = int(-math.log(max((state >> 11) / 2**53, 1e-12)) / math.log(links))
    return out


def nearest_links(data: np.ndarray, width: int) -> np.ndarray:
    """For each row the ``width`` nearest others, after links were made both ways; -1 fills up."""
    n = len(data)
    out = np.full((n, width), -1, np.int64)
    keep = min(width, n - 1)
    if keep < 1:
        return out
    sizes = (data**2).sum(1)
    own = np.empty((n, keep), np.int64)
    for at in range(0, n, 512):
        far = sizes - 2 * data[at : at + 512] @ data.T
        far[np.arange(len(far)), np.arange(at, at + len(far))] = np.inf
        own[at : at + 512] = np.argpartition(far, keep - 1, axis=1)[:, :keep]
    a = np.concatenate([np.repeat(np.arange(n), keep), own.ravel()])
    b = np.concatenate([own.ravel(), np.repeat(np.arange(n), keep)])
    a, b = np.unique(np.stack([a, b]), axis=1)
    far = ((data[a] - data[b]) ** 2).sum(1)
    order = np.lexsort((b, far, a))
    a, b = a[order], b[order]
    place = np.arange(len(a)) - np.searchsorted(a, a)
    near = place < width
    out[a[near], place[near]] = b[near]
    return out


class Graph:
    """The layered graph of one shard."""

    def __init__(self, sids: np.ndarray, data: np.ndarray, links: int = LINKS, lowest: int = LOWEST_LINKS):
        self.sids, self.data = sids, data
        self.levels = drawn_levels(len(sids), links)
        self.layers: list[tuple[np.ndarray, np.ndarray]] = []  # members, their links as positions among them
        for level in range(int(self.levels.max(initial=-1)) + 1):
            members = np.flatnonzero(self.levels >= level)
            self.layers.append((members, nearest_links(data[members], links if level else lowest)))

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, sids=self.sids, data=self.data, levels=self.levels, **{f"{kind}{i}": x for i, layer in enumerate(self.layers) for kind, x in zip("ml", layer, strict=True)})
        return out.getvalue()

    @classmethod
    def load(cls, data: bytes) -> Graph:
        out, held = cls.__new__(cls), np.load(io.BytesIO(data))
        out.sids, out.data, out.levels = held["sids"], held["data"], held["levels"]
        out.layers = [(held[f"m{i}"], held[f"l{i}"]) for i in range(int(out.levels.max(initial=-1)) + 1)]
        return out

    def beam(self, query: np.ndarray, level: int, start: int, ef: int) -> list[tuple[float, int]]:
        """The up to ``ef`` nearest nodes met in a layer, walking from one; (distance, node) ascending."""
        members, links = self.layers[level]

        def far(places: np.ndarray) -> np.ndarray:
            return ((self.data[members[places]] - query) ** 2).sum(1)

        at = int(np.searchsorted(members, start))
        seen = np.zeros(len(members), bool)
        seen[at] = True
        d = float(far(np.array([at]))[0])
        todo, best = [(d, at)], [(-d, at)]
        while todo:
            d, at = heapq.heappop(todo)
            if d > -best[0][0] and len(best) >= ef:
                break
            near = links[at]
            near = near[near >= 0]
            near = near[~seen[near]]
            seen[near] = True
            for x, place in zip(far(near).tolist(), near.tolist(), strict=True):
                if len(best) < ef or x < -best[0][0]:
                    heapq.heappush(todo, (x, place))
                    heapq.heappush(best, (-x, place))
                    if len(best) > ef:
                        heapq.heappop(best)
        return sorted((-x, int(members[place])) for x, place in best)

    def search(self, query: np.ndarray, k: int, ef: int) -> list[tuple[int, float]]:
        """(sid, distance) of about the k nearest."""
        if not len(self.sids):
            return []
        at = int(self.layers[-1][0][0])
        for level in range(len(self.layers) - 1, 0, -1):
            at = self.beam(query, level, at, 1)[0][1]
        return [(int(self.sids[i]), d) for d, i in self.beam(query, 0, at, max(ef, k))[:k]]


def build(vectors: DataFrame, dim: int, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row (shard, n, graph) per shard of ``vectors`` (sid, embedding). Vectors are dealt out by
    the hash of their sid, so a shard has about ``shard_rows`` of them whatever the table's size."""
    fitting = vectors.where(F.size("embedding") == dim).select("sid", "embedding")
    shards = max(1, -(-fitting.count() // shard_rows))

    def of_shard(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("sid")
        graph = Graph(rows["sid"].to_numpy(), np.stack(rows["embedding"].to_numpy()).astype(np.float64))
        return pd.DataFrame([(int(rows["shard"].iloc[0]), len(rows), graph.dump())], columns=["shard", "n", "graph"])

    return fitting.withColumn("shard", shard_of(F.col("sid"), shards)).groupBy("shard").applyInPandas(of_shard, SCHEMA)


def search_batch(shards: DataFrame, queries: DataFrame, k: int, ef: int) -> DataFrame:
    """(query_id, sid, dist, place) of about the k nearest for every query (query_id, vector)."""
    kind = dict(queries.dtypes)["query_id"]

    def found(block: tuple[np.ndarray, np.ndarray]) -> DataFrame:
        sent = shards.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for data in batch["graph"]:
                    graph = Graph.load(data)
                    rows = [(q, *hit) for q, vector in zip(*sent.value, strict=True) for hit in graph.search(vector, k, ef)]
                    yield pd.DataFrame(rows, columns=["query_id", "sid", "dist"])

        return shards.select("graph").mapInPandas(run, f"query_id {kind}, sid bigint, dist double")

    return knn.best(reduce(DataFrame.union, [found(block) for block in knn.query_sets(queries)]), k)
