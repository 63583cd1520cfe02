"""URL filter by association rules.

FP-growth mines combinations of URL tokens that go with a bad label, rules are pruned by count,
confidence and what chance would give, and an inverted index from each rule's rarest token finds the
rules a URL meets.
Explicit rules of (host, path) come first: the longest that fits decides.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import kept, sized_join

BAD = "=bad"

#: (verdict, rule): the rule is a host, and from its first slash on a path.
RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))


def rest(url: Column) -> Column:
    """What follows the first ``://``; null without one."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def host(url: Column) -> Column:
    """Up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty for null or without ``://``."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.coalesce(F.translate(F.regexp_extract(rest(url), r"^[^/?#]*", 0), upper, upper.lower()), F.lit(""))


def path(url: Column) -> Column:
    """From the host up to ``?``, ``#`` or the end; empty for null or without ``://``."""
    return F.coalesce(F.regexp_extract(rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def tokens(url: Column) -> Column:
    """Distinct tokens: host labels and their hyphenated parts, path words, extension, query keys.

    Numbers are left out, as an id tells nothing of other URLs. Each kind has a prefix.
    """
    query = F.coalesce(F.regexp_extract(rest(url), r"\?([^#]*)", 1), F.lit(""))
    labels = F.transform(F.split(host(url), r"\."), lambda x: F.concat(F.lit("h:"), x))
    parts = F.transform(F.split(host(url), r"[.\-]"), lambda x: F.concat(F.lit("w:"), x))
    paths = F.transform(F.split(path(url), r"[/._\-]"), lambda x: F.concat(F.lit("p:"), x))
    keys = F.transform(F.split(query, "&"), lambda x: F.concat(F.lit("q:"), F.substring_index(x, "=", 1)))
    both = F.array_distinct(F.concat(labels, F.array_except(parts, F.transform(labels, lambda x: F.concat(F.lit("w:"), F.substring(x, F.lit(3), F.length(x))))), paths, keys))
    return F.sort_array(F.filter(both, lambda x: (F.length(x) > 2) & ~x.rlike(r"^.:[0-9]+$")))


def alike(rows: DataFrame, min_count: int) -> DataFrame:
    """(token, instead): the tokens of ``rows`` (items) that are in ``min_count`` rows at least, and for
    those that are in the very same rows one of them, a host's label before other kinds.

    Rows are told apart by the XXH64 of their items: tokens are taken for alike if they are in as many
    rows and the sums of the rows' hashes are equal.
    """
    signed = rows.select(F.explode("items").alias("token"), F.xxhash64("items").cast("decimal(38,0)").alias("h"))
    marks = signed.groupBy("token").agg(F.count("*").alias("n"), F.sum("h").alias("h")).where(F.col("n") >= min_count)
    return marks.select("token", F.min("token").over(Window.partitionBy("n", "h")).alias("instead"))


def mine(labelled: DataFrame, min_support: float = 0.0, min_confidence: float = 0.6, min_count: int = 5, alpha: float = 0.05) -> DataFrame:
    """Rules (antecedent, confidence, support) that predict bad, from (url, bad) rows.

    A rule needs ``min_count`` bad rows whatever the size of the table, the confidence, and a lift
    that chance doesn't explain: if bad rows fell on token sets by chance, all rules of this table
    together would come up with a probability of ``alpha`` at most (Chernoff's bound on the binomial
    tail, divided among the token sets tested). A rule is left out if a rule of fewer tokens, all
    among its own, is as confident. Rows with a null label don't count; too few labels, labels all
    alike and empty tables give no rules.

    Tokens that are always together are mined as one, as n of them would make 2 ** n sets. The
    sets mined are those in ``min_count`` rows, and their number has no other bound;
    ``min_support``, a share of the labelled rows, is for callers who want fewer.
    """
    rows = kept(labelled.where(F.col("bad").isNotNull()).select(tokens(F.col("url")).alias("items"), "bad"))
    n, n_bad = rows.agg(F.count("*"), F.count(F.when(F.col("bad"), 1))).first()
    if n < min_count or n_bad in (0, n):
        return labelled.sparkSession.createDataFrame([], "antecedent array<string>, confidence double, support double")
    sets = rows.select("items").distinct().withColumn("token", F.explode("items"))
    merged = sets.join(alike(rows, min_count), "token").groupBy("items").agg(F.sort_array(F.collect_set("instead")).alias("fewer"))
    none = F.array().cast("array<string>")
    mark = F.when(F.col("bad"), F.array(F.lit(BAD))).otherwise(none)
    fed = kept(rows.join(merged, "items", "left").select(F.concat(F.coalesce("fewer", none), mark).alias("items")))
    # half a row less, as FP-growth rounds the count up and min_count / n * n can exceed min_count
    model = FPGrowth(itemsCol="items", minSupport=max(min_support, (min_count - 0.5) / n), minConfidence=min_confidence).fit(fed)
    tested = model.freqItemsets.where(~F.array_contains("items", BAD)).count()
    rules = model.associationRules.where(F.col("consequent") == F.array(F.lit(BAD)))
    share, base = F.col("confidence"), n_bad / n
    rest = F.when(share < 1, (1 - share) * F.ln((1 - share) / (1 - base))).otherwise(F.lit(0.0))
    surprise = F.col("support") * n / share * (share * F.ln(share / base) + rest)
    rules = rules.where((share > base) & (surprise >= math.log(max(tested, 1) / alpha)))
    rules = kept(rules.select(F.sort_array("antecedent").alias("antecedent"), "confidence", "support"))
    keyed = rules.withColumn("first", F.explode("antecedent"))
    short = rules.select(F.col("antecedent").alias("inner"), F.col("confidence").alias("inner_confidence"), F.col("antecedent")[0].alias("first"))
    covers = (F.size("inner") < F.size("antecedent")) & (F.size(F.array_except("inner", "antecedent")) == 0) & (F.col("inner_confidence") >= F.col("confidence"))
    implied = keyed.join(short, "first").where(covers).select("antecedent").distinct()
    return rules.join(implied, "antecedent", "left_anti")


def inverted_index(rules: DataFrame, sets: DataFrame) -> DataFrame:
    """One posting per rule, under that of its tokens which the fewest of ``sets`` (items) have:
    (token, antecedent, confidence)."""
    each = rules.select("antecedent", "confidence", F.explode("antecedent").alias("token"))
    used = each.select("token").distinct()
    spread = sets.select(F.explode("items").alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    spread = used.join(spread, "token", "left").select("token", F.coalesce("n", F.lit(0)).alias("n"))
    rarest = each.join(spread, "token").groupBy("antecedent").agg(F.min(F.struct("n", "token")).alias("least"), F.first("confidence").alias("confidence"))
    return rarest.select(F.col("least.token").alias("token"), "antecedent", "confidence")


def match(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """Distinct token sets of ``urls`` (url) that meet a rule (items), with the highest confidence.

    A set meets the rules posted under its tokens only. As a rule is posted where the fewest sets
    meet it, a token that most URLs have, such as a common host's, has few postings.
    """
    sets = kept(urls.select(tokens(F.col("url")).alias("items")).distinct())
    index = kept(inverted_index(rules, sets))
    posted = sized_join(sets.withColumn("token", F.explode("items")), index, "token", "inner", index.count())
    met = posted.where(F.size(F.array_except("antecedent", "items")) == 0)
    return met.groupBy("items").agg(F.max("confidence").alias("confidence"))


def explicit(rules: Sequence[tuple[str, str]] = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest explicit rule that fits the columns host and path; null if none."""
    rule = verdict = F.lit(None).cast("string")
    for kind, text in sorted(rules, key=lambda r: len(r[1])):  # later ones, the longer, decide
        name, slash, begin = text.partition("/")
        fits = (F.col("host") == name) | F.col("host").endswith(f".{name}")
        fits &= F.col("path").startswith(slash + begin)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def judge(pages: DataFrame, labelled: DataFrame, rules: Sequence[tuple[str, str]] = RULES, **options) -> DataFrame:
    """page_id, host, path, rule, verdict and confidence per row of ``pages`` (page_id, url).

    ``labelled`` has (url, bad). Where no explicit rule fits, a URL that meets a mined rule is
    blocked and all others are allowed, null and malformed ones too. Repeated rows are judged
    alike; other columns are not used. An empty table gives no rows.
    """
    urls = pages.select("page_id", "url", tokens(F.col("url")).alias("items"), host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    met = kept(match(pages.select("url"), mine(labelled, **options)))  # apart from the join, whose hot keys can then be split
    rule, verdict = explicit(rules)
    learned = F.when(F.col("confidence").isNotNull(), F.lit("block")).otherwise(F.lit("allow"))
    return urls.join(met, "items", "left").select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, learned).alias("verdict"), "confidence")
