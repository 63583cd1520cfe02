"""Licence scan by canonical digests.

A text is brought to a canonical form (case, copyright lines, punctuation, white space and
equivalent spellings), the form's SHA-256 is its digest, and digests are joined with those of the
known licence texts. Whole documents are looked up, and whole lines, for notices inside documents.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import kept, sized_join, whole
from .license_texts import EQUIVALENT, KNOWN

#: A line that states a copyright: its year or sign must follow, so "copyright holders" isn't one.
COPYRIGHT = (
    r"(?:^|\n)[ \t]*(?:(?:\(c\)|©)[^\n]*|copyright[ \t]*(?:\(c\)|©|:|[0-9]{4}|<year>|\[year\])[^\n]*"
    r"|all rights reserved\.?[ \t]*(?:\n|$))"
)
OTHER = r"[^\p{L}\p{N}]+"

#: Equivalents of two words, replaced with the space before them.
PARTED = [
    ("sub license", "sublicense"),
    ("sub licence", "sublicense"),
    ("non infringement", "noninfringement"),
    ("non commercial", "noncommercial"),
    ("per cent", "percent"),
    ("copyright owner", "copyright holder"),
]


def bare_words(text: Column) -> Column:
    """The words of a text in lower case, without copyright lines and punctuation, two-word
    equivalents made one; [""] for null and texts without letters or digits."""
    bare = F.regexp_replace(F.lower(whole(text)), COPYRIGHT, "\n")
    bare = F.concat(F.lit(" "), F.trim(F.regexp_replace(bare, OTHER, " ")))
    for parted, joined in PARTED:
        bare = F.replace(bare, F.lit(f" {parted}"), F.lit(f" {joined}"))
    return F.split(F.trim(bare), " ")


def spelt(words: Column) -> Column:
    """The canonical form of bare words."""
    same = F.create_map(*[F.lit(x) for pair in EQUIVALENT for x in pair])
    return F.array_join(F.transform(words, lambda w: F.coalesce(F.try_element_at(same, w), w)), " ")


def canonical(text: Column) -> Column:
    """The canonical form; null and texts without letters or digits give the empty string."""
    return spelt(bare_words(text))


def digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def known_digests(spark: SparkSession, known: Sequence[tuple[str, str]] | DataFrame = KNOWN) -> DataFrame:
    """(known_digest, license_id, n_words), one row per digest; blank and null known texts are left out."""
    texts = known if isinstance(known, DataFrame) else spark.createDataFrame(list(known), "license_id string, text string")
    found = texts.select(digest(F.col("text")).alias("known_digest"), "license_id", F.size(bare_words(F.col("text"))).alias("n_words"))
    empty = F.sha2(F.lit(""), 256)
    return found.where(F.col("known_digest") != empty).groupBy("known_digest").agg(F.min("license_id").alias("license_id"), F.min("n_words").alias("n_words"))


def scan(docs: DataFrame, known: Sequence[tuple[str, str]] | DataFrame = KNOWN) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, digest, license_id and line_licenses.

    license_id is the licence whose known text the whole document is, else null. line_licenses is
    the sorted array of licences that whole lines of the document state (empty if none); rows that
    share a doc_id share it. Null texts count as empty and match nothing; other columns are not
    used. An empty table gives no rows.
    """
    digests = kept(known_digests(docs.sparkSession, known))
    n, lengths = digests.count(), digests.agg(F.collect_set("n_words")).first()[0]
    digests = digests.drop("n_words")
    forms = docs.select("doc_id", digest(F.col("text")).alias("digest"))
    whole_text = sized_join(forms, digests, forms["digest"] == digests["known_digest"], "left", n).drop("known_digest")
    # a line is spelt and digested only if some known text has as many words
    lines = F.filter(F.transform(F.split(whole("text"), "\n", -1), bare_words), lambda w: F.size(w).isin(lengths) & (F.get(w, F.lit(0)) != ""))
    lines = docs.select("doc_id", F.explode(lines).alias("words")).select("doc_id", F.sha2(spelt(F.col("words")), 256).alias("digest"))
    hits = sized_join(lines, digests, lines["digest"] == digests["known_digest"], "inner", n)
    stated = hits.groupBy(F.col("doc_id").alias("stated_id")).agg(F.sort_array(F.collect_set("license_id")).alias("line_licenses"))
    joined = whole_text.join(stated, whole_text["doc_id"].eqNullSafe(stated["stated_id"]), "left")
    none = F.array().cast("array<string>")
    return joined.select("doc_id", "digest", "license_id", F.coalesce("line_licenses", none).alias("line_licenses"))
