"""Bounded samples of labelled documents, for fitting classifiers on the driver."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import whole


def fold(parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % parts


def labelled(docs: DataFrame, labels: DataFrame, label: str, usable: Column, rows_per_class: dict[int, int], max_chars: int) -> pd.DataFrame:
    """(text, label) of at most ``rows_per_class`` labelled documents of each class.

    ``labels`` has (doc_id, label); rows with a null label don't count, an id with several labels
    or texts has the least, and ``usable`` says by doc_id which may be learned from. The sample is the
    first by a hash of the id, the same in each run. Texts above ``max_chars`` are not learned
    from, so the sample is at most sum(rows_per_class) * max_chars code points.
    """
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & usable)
    known = known.groupBy("doc_id").agg(F.min(label).cast("int").alias("label"))
    texts = docs.select("doc_id", whole("text").alias("text")).where(F.length("text") <= max_chars)
    known = known.join(texts.select("doc_id").distinct(), "doc_id", "left_semi")
    parts = [known.where(F.col("label") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for value, n in rows_per_class.items()]
    chosen = parts[0]
    for part in parts[1:]:
        chosen = chosen.union(part)
    rows = texts.join(F.broadcast(chosen), "doc_id")  # bounded by rows_per_class
    rows = rows.groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    return rows.select("doc_id", "text", "label").toPandas().sort_values("doc_id", ignore_index=True)
