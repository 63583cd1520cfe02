"""Indexes of an engine: what answers "the k nearest vectors", exactly or about.

An index is built from the vector view and kept as files; the engine joins what it finds with the
current facts, so a fact that was deleted since isn't shown. Any object with these three methods
will do.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import blocks, graph, knn
from ..storage import shared_path


class Index(Protocol):
    def build(self, vectors: DataFrame, dim: int) -> None:
        """Takes in all of ``vectors`` (sid, embedding and others), in place of what it held."""

    def search(self, query: Sequence[float], k: int, ef: int) -> DataFrame:
        """(sid, dist) of up to k near vectors, dist squared; more ``ef``, more effort."""

    def size(self) -> int:
        """Vectors held."""


class Stored:
    """What the indexes share: files in a folder, a new one for each build, the old one deleted."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.folder = spark, path or shared_path(spark, "index")
        self.built = 0

    @property
    def path(self) -> str:
        return f"{self.folder}/{self.built}"

    def replace(self, write) -> None:
        from ..sources.files import Files

        old, self.built = self.path, self.built + 1
        write(self.path)
        if self.built > 1:
            Files(self.spark).delete(old)


class Exact(Stored):
    """All vectors are measured."""

    def build(self, vectors: DataFrame, dim: int) -> None:
        self.replace(lambda path: vectors.select("sid", "embedding").write.parquet(path))

    def search(self, query: Sequence[float], k: int, ef: int) -> DataFrame:
        return knn.nearest(self.spark.read.parquet(self.path), query, k).select("sid", "dist")

    def size(self) -> int:
        return self.spark.read.parquet(self.path).count()


class Inverted(Stored):
    """Clustered blocks, of which those whose centres are nearest are read: a share of them that
    grows with the effort, all at ``full`` and beyond."""

    def __init__(self, spark: SparkSession, cells: int = 64, full: int = 256, path: str | None = None):
        super().__init__(spark, path)
        self.cells, self.full = cells, full

    def build(self, vectors: DataFrame, dim: int) -> None:
        fitting = vectors.where(F.size("embedding") == dim)
        self.replace(lambda path: blocks.write(blocks.assign_kmeans(fitting, self.cells), path))

    def search(self, query: Sequence[float], k: int, ef: int) -> DataFrame:
        store = blocks.Stored(self.spark, self.path)
        probes = max(1, -(-min(ef, self.full) * self.cells // self.full))
        return knn.nearest(store.rows(store.nearest_blocks(query, probes)), query, k).select("sid", "dist")

    def size(self) -> int:
        return blocks.Stored(self.spark, self.path).described().agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


class Blocks(Inverted):
    """Clustered blocks, of which those that can't hold one of the k nearest are skipped: exact."""

    def search(self, query: Sequence[float], k: int, ef: int) -> DataFrame:
        found, _ = blocks.Stored(self.spark, self.path).near(query, k)
        return found.select("sid", (F.col("dist") * F.col("dist")).alias("dist"))


class Graph(Stored):
    """Layered neighbour graphs of shards."""

    def __init__(self, spark: SparkSession, shard_rows: int = graph.SHARD_ROWS, path: str | None = None):
        super().__init__(spark, path)
        self.shard_rows = shard_rows

    def build(self, vectors: DataFrame, dim: int) -> None:
        self.replace(lambda path: graph.build(vectors, dim, self.shard_rows).write.parquet(path))

    def search(self, query: Sequence[float], k: int, ef: int) -> DataFrame:
        asked = self.spark.createDataFrame([(0, [float(x) for x in query])], "query_id bigint, vector array<double>")
        return graph.search_batch(self.spark.read.parquet(self.path), asked, k, ef).select("sid", "dist")

    def size(self) -> int:
        return self.spark.read.parquet(self.path).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
