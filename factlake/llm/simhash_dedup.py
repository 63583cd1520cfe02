"""SimHash near-duplicates through covering locality-sensitive hashing.

Fingerprints are bit majorities of the hashes of 3-word shingles. To each bit position belongs a
non-zero vector of radius + 1 bits; for each non-zero vector v the mask of the positions whose
vector has an odd product with v gives one hash table. Up to ``radius`` differing positions leave
some v orthogonal to all of them, so the pair agrees under v's mask: no pair within the radius is
missed. Links are sought among distinct fingerprints, bucket by bucket; a bucket above the bound is
split by a second set of masks on top of the first (which keeps the guarantee), until buckets are
small, so no group is gathered whole and no pairs of a group are written out.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import votes
from .common import fresh, kept, shingles, sized_join, whole, words

RADIUS = 3
BITS = 64

#: Distinct fingerprints that one bucket may hold before it is split further: 256 KB, and seconds of
#: comparing at worst. A dense bucket is linked in few steps, as each step takes out what it finds.
BUCKET = 32_768

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def lower_words(text: Column | str) -> Column:
    """Words with A-Z, and no other letters, lower-cased."""
    return words(F.translate(whole(text), UPPER, UPPER.lower()))


def fingerprints(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, text_hash and fp (long).

    Null, empty and blank texts have no shingles and fingerprint 0. Other columns are not used.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.xxhash64(whole("text")).alias("text_hash"), lower_words("text").alias("w"))
    rows = rows.select("row", "doc_id", "text_hash", F.inline_outer(shingles(F.col("w"), 3)))
    parts = [F.col(c) for c in rows.columns[3:]]
    hashed = rows.select("row", "doc_id", "text_hash", F.when(parts[0].isNotNull(), F.xxhash64(F.concat_ws(" ", *parts))).alias("h"))
    counted = hashed.groupBy("row", "doc_id", "text_hash").agg(F.count("h").alias("n"), *votes.sums("b", F.col("h")))
    return counted.select("doc_id", "text_hash", F.coalesce(votes.majority("b", F.col("n")), F.lit(0)).cast("long").alias("fp"))


def covering_masks(radius: int = RADIUS, bits: int = BITS, level: int = 0) -> list[int]:
    """2 ** (radius + 1) - 1 masks as signed 64-bit numbers; each level has its own order of positions."""
    vectors = [i % (2 ** (radius + 1) - 1) + 1 for i in range(bits)]
    random.Random(level).shuffle(vectors)
    masks = [sum(1 << i for i, m in enumerate(vectors) if (m & v).bit_count() % 2) for v in range(1, 2 ** (radius + 1))]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def tables(members: DataFrame, masks: list[int]) -> DataFrame:
    """(fp, mask, key): each member once per mask; ``mask`` adds to the member's own.

    Members of several levels can come to the same mask by several ways: such rows are equal.
    """
    each = F.explode(F.array(*[F.lit(m) for m in masks])).alias("more")
    out = members.select("fp", "mask", each).select("fp", F.col("mask").bitwiseOR(F.col("more")).alias("mask"))
    return out.select("fp", "mask", F.col("fp").bitwiseAND(F.col("mask")).alias("key"))


def linked(fps: np.ndarray, radius: int) -> Iterator[tuple[int, int]]:
    """Tree edges that join exactly those fingerprints of one bucket that links connect."""
    rest = np.sort(fps)
    while len(rest):
        root, front, rest = rest[0], [rest[0]], rest[1:]
        while front and len(rest):
            near = np.bitwise_count(rest ^ front.pop()) <= radius
            if near.any():
                found = rest[near]
                rest = rest[~near]
                front.extend(found)
                yield from ((int(x), int(root)) for x in found)


def bucket_edges(radius: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            edges = [e for fps in batch["fps"] for e in linked(np.asarray(fps, dtype=np.int64).view(np.uint64), radius)]
            yield pd.DataFrame(np.array(edges, dtype=np.uint64).reshape(-1, 2).view(np.int64), columns=["a", "b"])

    return run


def near_links(distinct: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """Edges (a, b) whose components are those of all links within the radius.

    ``distinct`` has one column fp, each value once. Every level costs two shuffles of the members
    of the buckets still above the bound; ``bucket`` bounds what one task gathers per bucket.
    """
    members, edges, level = distinct.select("fp", F.lit(0).cast("long").alias("mask")), [], 0
    while True:
        keyed = tables(members, covering_masks(radius, level=level))
        keyed = keyed.distinct() if level else keyed
        counts = kept(keyed.groupBy("mask", "key").agg(F.count("*").alias("n")).where("n > 1"))
        shared = keyed.join(counts, ["mask", "key"])
        small = shared.where(F.col("n") <= bucket).groupBy("mask", "key").agg(F.collect_list("fp").alias("fps"))
        edges.append(kept(small.select("fps").mapInPandas(bucket_edges(radius), "a long, b long").distinct()))
        if counts.where(F.col("n") > bucket).isEmpty():
            return reduce(DataFrame.union, edges)
        members, level = kept(shared.where(F.col("n") > bucket).select("fp", "mask")), level + 1


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b) that isn't its component's least node.

    Alternates two steps until nothing changes: tie every greater neighbour of a node to the
    node's least neighbour, then every lesser or equal one. Each round is written to the shared
    folder, so lost executors cost one round at most; rounds grow with the logarithm of the size.
    """

    def state(df: DataFrame):
        return df.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))")).first()

    a, b = F.col("a"), F.col("b")
    now = kept(edges.where(a != b).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct())
    seen = state(now)
    while True:
        both = now.union(now.select(b, a))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where(b > a).select(b.alias("a"), F.col("m").alias("b")).where(a != b).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(b.alias("a"), F.col("m").alias("b")).where(a != b)
        now = kept(small.union(least.select("a", F.col("m").alias("b"))).distinct())
        was, seen = seen, state(now)
        if seen == was:
            return now.select(a.alias("node"), b.alias("root"))


def classes(marked: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """``marked`` (doc_id, fp, ...) with component_id: the least doc_id that links reach.

    Equal fingerprints are one class whatever their number; null ids aren't taken for least
    unless a component has no other.
    """
    each = kept(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    roots = components(near_links(each.select("fp"), radius, bucket))
    tied = each.join(roots, each["fp"] == roots["node"], "left").withColumn("root", F.coalesce("root", "fp"))
    tied = kept(tied.select("fp", "root", "first_id"))
    least = kept(tied.groupBy("root").agg(F.min("first_id").alias("component_id")))  # apart from the join, whose hot keys can then be split
    by_fp = tied.join(least, "root").select("fp", "component_id")
    return marked.join(by_fp, "fp")


def find_near_duplicates(docs: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """doc_id, text_hash, fp and component_id, one row per row of ``docs`` (doc_id, text).

    Null and blank texts have fingerprint 0 and are linked like others. Repeated rows are repeated
    in the result. A null doc_id counts in no component_id, so a component without ids has a null
    one. Columns other than the two are not used; an empty table gives no rows.
    """
    return classes(kept(fingerprints(docs)), radius, bucket)


def drop_near_duplicates(docs: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """``docs`` with one row of each component: that of the least doc_id (null last), then text hash.

    All columns stay. Of rows that are equal in doc_id and text one stays. An empty table gives no
    rows. What is dropped is looked up by (doc_id, text hash); texts are read twice and shuffled
    only when more rows are dropped than may be broadcast.
    """
    found = find_near_duplicates(docs, radius, bucket)
    found = kept(found.groupBy("component_id", "doc_id", "text_hash").agg(F.count("*").alias("n")))
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")
    best = found.groupBy("component_id").agg(F.min(order).alias("best"))
    stays = found["doc_id"].eqNullSafe(F.col("best.doc_id")) & (found["text_hash"] == F.col("best.text_hash"))
    marked = kept(found.join(best, found["component_id"].eqNullSafe(best["component_id"])).select("doc_id", "text_hash", "n", stays.alias("stays")))
    h, i, t = fresh(docs, "dedup_hash", "dedup_id", "dedup_text")
    hashed = docs.withColumn(h, F.xxhash64(whole("text")))

    def keyed(df: DataFrame) -> tuple[DataFrame, Column]:
        keys = df.select(F.col("doc_id").alias(i), F.col("text_hash").alias(t))
        return keys, hashed["doc_id"].eqNullSafe(keys[i]) & (hashed[h] == keys[t])

    gone, on = keyed(marked.where(~F.col("stays") | (F.col("n") > 1)))
    out = sized_join(hashed, gone, on, "left_anti", gone.count())
    again, on = keyed(marked.where(F.col("stays") & (F.col("n") > 1)))
    if (n := again.count()):
        out = out.union(sized_join(hashed, again, on, "left_semi", n).dropDuplicates(["doc_id", h]))
    return out.select(*docs.columns)
