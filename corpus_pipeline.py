"""A training corpus from raw documents, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
read again as the next stage's docs. Every stage works on all that the one before it kept. All but
the last return the columns of ``documents``, and others that the table has; labels to learn from are
read from ``sf_dir``. Empty tables pass through, and repeated rows count as rows of their own until
near duplicates are dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from factlake.llm import bpe, mixing, quality_crf, simhash_dedup, toxicity
from factlake.llm.common import read, stored


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the network doesn't call toxic; null and empty texts are scored like others."""
    return toxicity.drop_toxic(docs, read(spark, sf_dir, "labels"))


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the field calls good; null and empty texts are scored like others."""
    return quality_crf.drop_low_quality(docs, read(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the least id; of equal rows one, null ids last."""
    return simhash_dedup.drop_near_duplicates(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's rate says; null sources are one source, texts without words aren't repeated."""
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of token digests per document; null texts are empty."""
    return bpe.encode(docs, bpe.installed())


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", drop_low_quality),
    ("near_duplicates", drop_near_duplicates),
    ("mixing", mix),
    ("bpe", encode),
]

#: The first two stages are fitted models and the third a closure over links: no SQL twin.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows, from ``documents`` in ``sf_dir``."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = stored(docs)
    return docs
