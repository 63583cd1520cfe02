"""The registered queries of this subpackage, and their DuckDB twins where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline

from . import bpe, chat_format, fingerprints, license_scan, mixing, quality_crf, quality_rules, simhash_dedup, toxicity, url_filter
from .common import kept, read
from .license_texts import EQUIVALENT, KNOWN
from .samples import fold
from .votes import hex64


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan(read(spark, sf_dir, "documents"))
    return found.withColumn("line_licenses", F.array_join("line_licenses", ","))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


OP1_SQL = f"""
WITH known(license_id, text) AS (VALUES {", ".join(f"({_quoted(i)}, {_quoted(t)})" for i, t in KNOWN)}),
same AS (SELECT MAP {{{", ".join(f"{_quoted(a)}: {_quoted(b)}" for a, b in EQUIVALENT)}}} AS m),
texts AS (
  SELECT 'known' AS kind, NULL::BIGINT AS doc_id, license_id, text FROM known
  UNION ALL SELECT 'doc', doc_id, NULL, coalesce(text, '') FROM documents
  UNION ALL SELECT 'line', doc_id, NULL, unnest(string_split(coalesce(text, ''), chr(10))) FROM documents
), bare AS (
  SELECT kind, doc_id, license_id,
    ' ' || trim(regexp_replace(regexp_replace(lower(text), {_quoted(license_scan.COPYRIGHT)}, chr(10), 'g'), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) AS b
  FROM texts
), joined AS (
  SELECT kind, doc_id, license_id, trim({"replace(" * len(license_scan.PARTED)}b{"".join(f", ' {a}', ' {b}')" for a, b in license_scan.PARTED)}) AS b FROM bare
), forms AS (
  SELECT kind, doc_id, license_id, sha256(array_to_string(list_transform(string_split(b, ' '), lambda w: coalesce(m[w], w)), ' ')) AS digest
  FROM joined, same
), digests AS (SELECT digest, min(license_id) AS license_id FROM forms WHERE kind = 'known' AND digest != sha256('') GROUP BY digest),
lines AS (
  SELECT f.doc_id, string_agg(DISTINCT d.license_id, ',' ORDER BY d.license_id) AS line_licenses
  FROM forms f JOIN digests d USING (digest) WHERE kind = 'line' GROUP BY f.doc_id
)
SELECT f.doc_id, f.digest, d.license_id, coalesce(l.line_licenses, '') AS line_licenses
FROM forms f LEFT JOIN digests d ON f.digest = d.digest LEFT JOIN lines l ON l.doc_id IS NOT DISTINCT FROM f.doc_id
WHERE kind = 'doc'
"""


def op2_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "labels")
    scored = quality_crf.score(docs, quality_crf.learn(docs, labels))
    held_out = (fold(3) == 1).alias("held_out")
    return scored.select("doc_id", held_out, "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = kept(fingerprints.fingerprint_edited(read(spark, sf_dir, "documents")))
    hi, lo = F.col("hi"), F.col("lo")
    least = rows.groupBy("k").agg(F.min(F.struct("hi", "lo")).alias("f"))
    following = least.select(F.col("k").alias("next_k"), F.col("f.hi").alias("nhi"), F.col("f.lo").alias("nlo"))
    prints = rows.groupBy("hi", "lo").agg(F.count("*").alias("n"))
    asked = (F.col("k") % 20 == 0) & (F.col("k") != fingerprints.NULL_ID)
    queries = rows.where(asked).select("hi", "lo").distinct()
    found = fingerprints.find_within(queries, prints, fingerprints.NEAR)
    listed = F.transform("found", lambda x: F.struct(fingerprints.text(x["hi"], x["lo"]).alias("fingerprint"), x["distance"].alias("distance")))
    found = found.select("hi", "lo", "n", fingerprints.documents(F.col("found"), fingerprints.RADIUS).alias("n_least"), listed.alias("near"))
    joined = rows.join(following, "next_k").join(kept(found), ["hi", "lo"], "left")
    return joined.select(
        F.when(F.col("k") != fingerprints.NULL_ID, F.col("k")).alias("doc_id"),
        "n_chars",
        F.concat(*[hex64(F.col(f"s{i}")) for i in range(4)]).alias("edited_sha256"),
        fingerprints.text(hi, lo).alias("fingerprint"),
        fingerprints.text(F.col("ehi"), F.col("elo")).alias("edited_fingerprint"),
        fingerprints.likeness(hi, lo, F.col("ehi"), F.col("elo")).alias("near_edited"),
        fingerprints.likeness(hi, lo, F.col("nhi"), F.col("nlo")).alias("near_next"),
        F.when(asked, F.col("n_least")).alias("n_within_3"),
        F.when(asked, F.col("n")).alias(f"n_within_{fingerprints.NEAR}"),
        F.when(asked, F.col("near")).alias("near"),
    )


def op4_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_dedup.find_near_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", hex64(F.col("fp")).alias("fingerprint"), "component_id")


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(read(spark, sf_dir, "documents"), bpe.installed())


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(read(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "labels")
    scored = toxicity.score(docs, toxicity.learn(docs, labels))
    held_out = (fold(4) == 2).alias("held_out")
    return scored.select("doc_id", held_out, "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    bad = (F.col("quality") == 0) | (F.col("toxic") == 1)
    labels = read(spark, sf_dir, "labels").groupBy(F.col("doc_id").alias("page_id")).agg(F.max(bad).alias("bad"))  # a page counts once
    return url_filter.judge(pages, pages.join(labels, "page_id").select("url", "bad"))


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = r"\### Assistant: </turn> ok"
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(said).alias("text"),
    )
    chats = chat_format.format_chats(turns.unionByName(own))
    back = chats.withColumn("turns", chat_format.parse_chats(F.col("formatted")))
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    lost = chat_format.loss_text(F.col("segments"))
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.length(lost).cast("long").alias("loss_chars"),
        F.sha2(lost, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
    )


OP9_SQL = r"""
WITH rows_ AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), escaped AS (
  SELECT *, row_number() OVER w AS nr, lag(role, 1, '') OVER w AS was,
    replace(replace(replace(text, '\', '\b'), '</turn>', '\e'), '### ', '\h') AS body,
    replace(replace(replace(replace(role, '\', '\b'), '</turn>', '\e'), '### ', '\h'), ':', '\m') AS head
  FROM rows_
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY nr)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY nr) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(4 + length(head) + 2 + length(body) + 8)::BIGINT AS formatted_chars,
  bool_and((was, role) IN (('', 'system'), ('', 'user'), ('system', 'user'), ('user', 'assistant'), ('assistant', 'user')))
    AND arg_max(role, nr) = 'assistant' AS valid
FROM escaped GROUP BY conv_id
"""


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", "text")
    planned = mixing.plan_mix(docs)
    return planned.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


OP10_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents
), sources AS (
  SELECT source, sum(size)::DOUBLE AS source_size FROM sized GROUP BY source
), weighted AS (
  SELECT *, 2 * source_size AS most,
    [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)]::DOUBLE AS weight
  FROM sources
), levels AS (
  SELECT *, (1.5 * sum(source_size) OVER ()
      - coalesce(sum(most) OVER (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighted
), targets AS (
  SELECT source, source_size, least(most, weight * max(level) OVER ()) AS target FROM levels
), rated AS (
  SELECT s.doc_id, s.size, t.source_size, t.target,
    CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
    ('0x' || substr(md5('mix-1:' || coalesce(s.doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0 AS u
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size::BIGINT AS source_size, target,
  (size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM rated
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_license_scan": op1_license_scan,
    "op2_quality_crf": op2_quality_crf,
    "op3_fingerprints": op3_fingerprints,
    "op4_simhash_dedup": op4_simhash_dedup,
    "op5_bpe": op5_bpe,
    "op6_quality_rules": op6_quality_rules,
    "op7_toxicity": op7_toxicity,
    "op8_url_filter": op8_url_filter,
    "op9_chat_format": op9_chat_format,
    "op10_mixing": op10_mixing,
    "pipeline": pipeline,
}

ORACLES: dict[str, str] = {"op1_license_scan": OP1_SQL, "op9_chat_format": OP9_SQL, "op10_mixing": OP10_SQL}
