"""Mixing sources to target weights by repetition rates.

Tokens are summed per source, the sums give each source a target, target over size is its
repetition rate, and a document is emitted floor(rate) times plus one copy drawn by a hash of its
id with the rate's fraction as probability.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, kept, sized_join, words

WEIGHTS = (5, 2, 1)
SHARE = 1.5
CAP = 2.0
SEED = "mix-1"

#: 13 hexadecimal digits are 52 bits, which a double holds exactly.
DIGITS = 13


def source_targets(
    sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, cap: float = CAP
) -> DataFrame:
    """Targets of (source, source_size), one row per source; null is a source and comes last.

    Sources in code-point order take ``weights`` in turn. Together they get ``share`` times all
    sizes, but none more than ``cap`` times its own size: what a capped source leaves is shared
    again by weight. The fixed point is target = min(cap * size, weight * level), and the level is
    the largest of (total - caps before) / (weights from here on) over the sources in order of
    cap * size / weight, so no loop is needed. A source of size 0 gets target 0. The windows run
    over one row per source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    ranked = sizes.withColumn(
        "weight", F.element_at(cycle, ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    ).withColumn("most", F.col("source_size") * F.lit(float(cap)))
    order = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum("most").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    after = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    everything = Window.partitionBy()
    total = F.sum("source_size").over(everything) * F.lit(float(share))
    levels = ranked.withColumn("level", (total - before) / after)
    level = F.max("level").over(everything)
    return levels.select("source", "source_size", F.least("most", F.col("weight") * level).alias("target"))


def draw(doc_id: Column, seed: str) -> Column:
    """A number in [0, 1) that depends on the id and the seed only (null counts as empty)."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, DIGITS), 16, 10).cast("double") / float(16**DIGITS)


def plan_mix(
    docs: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    share: float = SHARE,
    cap: float = CAP,
    seed: str = SEED,
    size: Column | None = None,
    names: Sequence[str] = ("size", "source_size", "target", "copies"),
) -> DataFrame:
    """Each row of ``docs`` with its size in words, its source's size and target, and its copies.

    Null texts have size 0; rows that share an id share the draw, so they are repeated alike; extra
    columns stay, but those with the ``names`` of the four new ones are replaced. An empty table
    gives no rows. Reruns give the same copies.
    """
    s, ss, t, c = names
    docs = docs.drop(*names)
    key, own = fresh(docs, "mix_source", "mix_size")
    sized = docs.withColumn(own, (F.size(words("text")) if size is None else size).cast("long"))
    sizes = sized.groupBy("source").agg(F.sum(own).alias("source_size"))
    targets = kept(source_targets(sizes, weights, share, cap))
    targets = targets.select(F.col("source").alias(key), F.col("source_size").alias(ss), F.col("target").alias(t))
    joined = sized_join(sized, targets, sized["source"].eqNullSafe(targets[key]), "left", targets.count())
    rate = F.when(F.col(ss) > 0, F.col(t) / F.col(ss)).otherwise(F.lit(0.0))
    extra = (draw(F.col("doc_id"), seed) < rate - F.floor(rate)).cast("long")
    return joined.withColumn(c, F.floor(rate) + extra).withColumnRenamed(own, s).drop(key)


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus: every document as often as ``plan_mix`` says, with the columns of ``docs``."""
    names = fresh(docs, "mix_n", "mix_total", "mix_target", "mix_copies")
    planned = plan_mix(docs, names=names, **options)
    again = F.explode(F.sequence(F.lit(1), F.col(names[3]).cast("int")))
    return planned.where(F.col(names[3]) > 0).withColumn(names[3], again).select(*docs.columns)
