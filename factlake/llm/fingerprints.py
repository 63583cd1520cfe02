"""Document fingerprints: SimHash over weighted terms, and search through permuted block tables.

A text's terms are its words, each weighing its length up to 8, and its pairs of neighbouring
words, each weighing 8; repeats count again. Two 64-bit hashes of a term vote on 128 signed bits.
The bits are cut into 8 blocks of 16, each with a share of the radius r: the shares, plus one each,
sum to r + 1. Two fingerprints within r differ in a block by its share at most, so a table per block,
probed at every value within the share, finds every fingerprint within the radius.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import votes
from .common import kept, whole, words

BITS = 128
RADIUS = 3

#: Radius for near copies. Of the 250 pairs of different texts under 6,000 characters of sf0.1 whose
#: 5-word shingles have a Jaccard likeness of 0.8 at least, none lies within 3 bits, the median
#: within 9 and all within 16; 2 bits are to spare.
NEAR = 18

BLOCKS = 8
WIDTH = BITS // BLOCKS

WORD_WEIGHT, PAIR_WEIGHT = 8, 8

#: Fingerprints of one part of a block table's bucket, about: a hot bucket is counted and spread over
#: as many parts as it needs.
MEMBERS = 256

#: Stands for a null doc_id in joins; a null id comes last in descending order.
NULL_ID = -(2**63)


def terms(text: Column) -> Column:
    """Array of (0: word, 1: next word or null), one per word; empty without words."""
    w = words(text)
    return F.arrays_zip(w.alias("0"), F.slice(w, 2, F.greatest(F.size(w), F.lit(1))).alias("1"))


def simhash(texts: DataFrame, keys: list[str], text: str) -> DataFrame:
    """``keys`` with hi and lo, the fingerprint's halves, one row per combination of keys.

    Texts without terms get fingerprint 0. Texts of equal keys vote together.
    """
    exploded = texts.select(*keys, F.inline_outer(terms(F.col(text))))
    one, two = exploded.columns[-2:]
    word, pair = F.col(one), F.concat_ws(" ", one, two)
    each = exploded.select(
        *keys,
        F.when(word.isNotNull(), F.xxhash64(word)).alias("w1"),
        F.when(word.isNotNull(), F.xxhash64(word, F.lit(1))).alias("w2"),
        F.when(F.col(two).isNotNull(), F.xxhash64(pair)).alias("p1"),
        F.when(F.col(two).isNotNull(), F.xxhash64(pair, F.lit(1))).alias("p2"),
        F.least(F.length(word), F.lit(WORD_WEIGHT)).cast("long").alias("weight"),
    )
    ones = F.lit(votes.ONES)
    aggs = [(F.sum("weight") + F.coalesce(F.sum(F.when(F.col("p1").isNotNull(), F.lit(PAIR_WEIGHT))), F.lit(0))).alias("n")]
    for half, w, p in (("h", "w1", "p1"), ("l", "w2", "p2")):
        for i in range(32):
            word_bits = F.shiftrightunsigned(F.col(w), i).bitwiseAND(ones) * F.col("weight")
            pair_bits = F.coalesce(F.shiftrightunsigned(F.col(p), i).bitwiseAND(ones), F.lit(0)) * PAIR_WEIGHT
            aggs.append(F.sum(word_bits + pair_bits).alias(f"{half}{i}"))
    counted = each.groupBy(*keys).agg(*aggs)
    halves = [F.coalesce(votes.majority(half, F.col("n")), F.lit(0)).cast("long").alias(name) for half, name in (("h", "hi"), ("l", "lo"))]
    return counted.select(*keys, *halves)


def distance(hi: Column, lo: Column, hi2: Column, lo2: Column) -> Column:
    return F.bit_count(hi.bitwiseXOR(hi2)) + F.bit_count(lo.bitwiseXOR(lo2))


def likeness(hi: Column, lo: Column, hi2: Column, lo2: Column) -> Column:
    """Share of equal bits, 0 to 1."""
    return 1 - distance(hi, lo, hi2, lo2) / float(BITS)


def text(hi: Column, lo: Column) -> Column:
    return F.concat(votes.hex64(hi), votes.hex64(lo))


def shares(radius: int) -> list[int]:
    """How many bits each block may differ by; -1 for blocks that needn't be looked at."""
    base, more = divmod(radius + 1, BLOCKS)
    return [base - 1 + (i < more) for i in range(BLOCKS)]


def block(hi: Column, lo: Column, i: int) -> Column:
    """The i-th block, as an int."""
    half, at = (hi, i) if i < BLOCKS // 2 else (lo, i - BLOCKS // 2)
    return F.shiftrightunsigned(half, 64 - WIDTH * (at + 1)).bitwiseAND(F.lit((1 << WIDTH) - 1)).cast("int")


def flips(share: int) -> list[int]:
    """The block values with at most ``share`` ones."""
    return [sum(1 << b for b in bits) for k in range(min(share, WIDTH) + 1) for bits in combinations(range(WIDTH), k)]


def find_within(queries: DataFrame, prints: DataFrame, radius: int = RADIUS, members: int = MEMBERS) -> DataFrame:
    """(hi, lo, n, found): for each distinct query fingerprint how many documents are within the
    radius, and the fingerprints they have, an array of (distance, hi, lo, n) in this order.

    ``queries`` has (hi, lo) and ``prints`` (hi, lo, n), each fingerprint once, n its documents. A
    table's bucket is kept as arrays of about ``members``, and a query is held against an array in
    place, so a hot bucket gives a row for each query and array, not one for each pair. A pair that
    several tables find is taken from the first. Documents of a fingerprint are the caller's to
    keep. Any radius from 0 is exact; probes per query grow with it (4 for 3, 496 for 18, 5,576 for
    31). Without queries or fingerprints nothing is found.
    """
    tables = [(i, share) for i, share in enumerate(shares(radius)) if share >= 0]

    def bucket(i: int) -> Column:
        return block(F.col("hi"), F.col("lo"), i) + F.lit(i << WIDTH)

    each = prints.select("hi", "lo", "n", F.explode(F.array(*[bucket(i) for i, _ in tables])).alias("b"))
    # at most 2 ** 19 buckets whatever the input, and one in ``members`` of the entries
    large = each.groupBy("b").agg(F.count("*").alias("size")).where(F.col("size") > members)
    part = F.pmod(F.xxhash64("hi", "lo"), F.ceil(F.coalesce("size", F.lit(1)) / members)).alias("part")
    rows = each.join(F.broadcast(large), "b", "left").groupBy("b", part).agg(F.collect_list(F.struct("hi", "lo", "n")).alias("members"))

    def probed(i: int, share: int) -> Column:
        return F.transform(F.lit(flips(share)), lambda m: bucket(i).bitwiseXOR(m))

    probes = F.flatten(F.array(*[probed(i, share) for i, share in tables]))
    asked = queries.select("hi", "lo", F.explode(probes).alias("b"))

    def first(x: Column) -> Column:
        met, differ = F.lit(None), (F.col("hi").bitwiseXOR(x["hi"]), F.col("lo").bitwiseXOR(x["lo"]))
        for i, share in reversed(tables):
            met = F.when(F.bit_count(block(*differ, i)) <= share, F.lit(i)).otherwise(met)
        return met

    def near(x: Column) -> Column:
        return (distance(F.col("hi"), F.col("lo"), x["hi"], x["lo"]) <= radius) & (first(x) == F.shiftright("b", WIDTH))

    def pair(x: Column) -> Column:
        return F.struct(distance(F.col("hi"), F.col("lo"), x["hi"], x["lo"]).alias("distance"), x["hi"].alias("hi"), x["lo"].alias("lo"), x["n"].alias("n"))

    pairs = F.transform(F.filter("members", near), pair)
    # the optimizer takes the probes to be as small as the queries they are exploded from, so it would broadcast millions of rows
    met = asked.join(rows.hint("merge"), "b").select("hi", "lo", F.explode(F.filter(F.array(pairs), lambda x: F.size(x) > 0)).alias("found"))  # nothing of empty ones
    found = met.groupBy("hi", "lo").agg(F.sort_array(F.flatten(F.collect_list("found"))).alias("found"))
    return found.select("hi", "lo", documents(F.col("found"), radius).alias("n"), "found")


def documents(found: Column, radius: int) -> Column:
    """How many documents ``found`` of ``find_within`` has within a radius, its own or a smaller one."""
    return F.aggregate(F.filter(found, lambda x: x["distance"] <= radius), F.lit(0).cast("long"), lambda a, x: a + x["n"])


def neighbours(docs: DataFrame) -> DataFrame:
    """(k, next_k, to_k, need) per distinct id k of ``docs`` (k, n_chars).

    next_k is the next id in descending order (after the last the first), to_k the id whose next
    is k, need the most code points it takes from k. Ids are range-partitioned; windows stay
    within a partition, and one row per partition ties them together, so no task orders all ids.
    """
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ids = docs.groupBy("k").agg(F.max(F.floor(F.col("n_chars") / 3)).alias("takes"))
    ranged = kept(ids.repartitionByRange(n, "k").withColumn("p", F.spark_partition_id()))
    ends = ranged.groupBy("p").agg(F.min(F.struct("k", "takes")).alias("low"), F.max("k").alias("high"))
    order = Window.orderBy("p")
    whole_range = Window.partitionBy()
    ends = ends.select(
        "p",
        F.coalesce(F.lead("low").over(order), F.min("low").over(whole_range)).alias("after"),
        F.coalesce(F.lag("high").over(order), F.max("high").over(whole_range)).alias("before"),
    )
    within = Window.partitionBy("p").orderBy("k")
    tied = ranged.select("p", "k", F.lag("k").over(within).alias("prev"), F.lead(F.struct("k", "takes")).over(within).alias("following"))
    tied = tied.join(F.broadcast(ends), "p")  # at most one row per shuffle partition
    to = F.coalesce("following", "after")
    return tied.select("k", F.coalesce("prev", "before").alias("next_k"), to["k"].alias("to_k"), to["takes"].alias("need"))


def fingerprint_edited(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): k, n_chars, hi, lo, the edited text's SHA-256 in
    four longs s0 to s3 and its fingerprint ehi, elo, and next_k.

    The edited text has its last third replaced by as much of the next document's beginning. Null
    texts are empty; a null id counts as the least, -2 ** 63; of rows that share an id, the one with
    the least text is the next document of others. A row is known by its id and the XXH64 and
    length of its text, not by a number that a task would give it, so a task that runs again finds
    the same; rows equal in these are fingerprinted once and repeated at the end. Texts are
    shuffled once by id, and beginnings once. An empty table gives no rows, and columns other than
    the two are not used, whatever their names.
    """
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("k"), whole("text").alias("text"))
    copies = kept(rows.groupBy("k", F.xxhash64("text").alias("t"), F.length("text").cast("long").alias("n_chars")).agg(F.count("*").alias("copies")))
    light = kept(neighbours(copies))
    heads = rows.join(light.select("k", "to_k", "need"), "k").select(F.col("to_k").alias("k"), F.substring(F.col("text"), F.lit(1), F.col("need")).alias("head"))
    heads = heads.groupBy("k").agg(F.min("head").alias("head"))
    n = F.length("text")
    took = F.floor(n / 3)
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - took), F.substring(F.col("head"), F.lit(1), took))
    both = rows.join(heads, "k").select("k", F.xxhash64("text").alias("t"), "text", edited.alias("edited"))  # the same shuffle of (k, text)
    sha = F.sha2("edited", 256)
    parts = [F.conv(F.substring(sha, 16 * i + 1, 16), 16, -10).cast("long").alias(f"s{i}") for i in range(4)]
    both = both.select("k", "t", F.length("text").cast("long").alias("n_chars"), *parts, F.array("text", "edited").alias("texts"))
    carried = ["k", "t", "n_chars", "s0", "s1", "s2", "s3"]
    each = both.select(*carried, F.posexplode("texts").alias("which", "text"))
    prints = simhash(each, [*carried, "which"], "text")  # copies vote alike, so they change nothing
    halves = [F.max(F.when(F.col("which") == w, F.col(c))).alias(name) for w, c, name in ((0, "hi", "hi"), (0, "lo", "lo"), (1, "hi", "ehi"), (1, "lo", "elo"))]
    single = prints.groupBy(*carried).agg(*halves)
    again = single.join(copies, ["k", "t", "n_chars"]).withColumn("nr", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return again.drop("nr", "copies", "t").join(light.select("k", "next_k"), "k")
