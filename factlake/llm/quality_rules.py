"""Quality rules as weak supervision.

Each rule votes good, bad or abstains on a document. Expectation-maximisation over the counts of
vote patterns estimates how often each rule votes good on good and on bad documents, and the
posterior probability of "good" decides, in place of a filter that all rules must pass.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, kept, whole, words

SYMBOLS = r"[#*$%&|<>]+"
#: A word of letters, inner marks and one stop at most.
PLAIN = r"^[\"'(«“„]?\p{L}[\p{L}\p{M}'’\-]*[.,;:!?)\"'»”“]?$"
WINDOW = 8
ROUNDS = 40

#: Pseudo-counts (good votes, bad votes) on good and on bad documents, and (good, bad) documents: one
#: document's worth each, so that rates stay off 0 and 1 and a small table is decided by its votes.
PRIOR_GOOD, PRIOR_BAD, PRIOR_CLASS = (0.9, 0.1), (0.5, 0.5), (0.8, 0.2)

#: Where the estimate begins: (share of good documents, rate of good votes on good and on bad ones).
#: The likeliest of the ends is taken.
STARTS = ((0.8, 0.9, 0.3), (0.95, 0.95, 0.5), (0.5, 0.9, 0.5))

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def measures(docs: DataFrame) -> DataFrame:
    """``docs`` with the BASE counts and n_lines, n_lettered, n_plain, n_again (words equal to
    the one before), n_upper; text counts as empty if null.

    Repeated windows are found by the XXH64 of their 8 words: two different windows of one text
    would have to share a 64-bit hash to be taken for equal.
    """
    (w, h, ln), names = fresh(docs, "rule_words", "rule_hashes", "rule_lines"), ["n_lines", "n_lettered", "n_plain", "n_again", "n_upper", *BASE]
    text = whole("text")
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    n = F.size(w)
    window = F.transform(F.sequence(F.lit(1), n - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(w, i, WINDOW)))
    out = docs.withColumn(w, words("text")).withColumn(ln, lines)
    out = out.withColumn(h, F.when(n >= WINDOW, window).otherwise(F.array().cast("array<bigint>")))
    out = out.withColumns(
        {
            "n_lines": F.size(ln).cast("long"),
            "n_dup_lines": (F.size(ln) - F.size(F.array_distinct(ln))).cast("long"),
            "n_words": n.cast("long"),
            "word_chars": F.length(F.array_join(w, "")).cast("long"),
            "n_symbols": (F.length(text) - F.length(F.regexp_replace(text, SYMBOLS, ""))).cast("long"),
            "n_lettered": F.size(F.filter(w, lambda x: x.rlike(r"\p{L}"))).cast("long"),
            "n_plain": F.size(F.filter(w, lambda x: x.rlike(PLAIN))).cast("long"),
            "n_again": F.size(F.filter(w, lambda x, i: x == F.get(F.col(w), i - 1))).cast("long"),
            "n_upper": (F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))).cast("long"),
            "n_repeat_words": F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(F.col(h))).cast("long"),
        }
    )
    return out.select(*docs.columns, *names)


def covered(hashes: Column) -> Column:
    """Words that lie in a window whose hash occurs twice or more."""
    placed = F.sort_array(F.transform(hashes, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    n = F.size(placed)

    def starts(arr: Column) -> Column:
        def twice(x: Column, i: Column) -> Column:
            before = F.get(arr, i - 1)["h"].eqNullSafe(x["h"])
            return F.when(before | F.get(arr, i + 1)["h"].eqNullSafe(x["h"]), x["i"])

        return F.sort_array(F.array_compact(F.transform(arr, twice)))

    # A one-element array binds what is computed once, so the lambdas don't compute it again.
    one = F.transform(F.array(placed), starts)
    length = lambda s: F.aggregate(F.transform(s, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(s, i + 1) - x, F.lit(WINDOW)))), F.lit(0), lambda a, b: a + b)
    return F.when(n > 0, F.transform(one, length)[0]).otherwise(F.lit(0))


def vote(good: Column, bad: Column) -> Column:
    return F.when(bad, F.lit(-1)).when(good, F.lit(1)).otherwise(F.lit(0))


def rules() -> dict[str, Column]:
    """Rule name -> vote: 1 good, -1 bad, 0 abstains. Ratios abstain on texts without words."""
    n, chars, lines = F.col("n_words"), F.col("word_chars"), F.col("n_lines")
    some = n > 0
    return {
        "length": vote(n >= 50, n < 20),
        "word_length": vote(some & chars.between(3 * n, 10 * n), some & ((chars < 2 * n) | (chars > 15 * n))),
        "symbols": vote(some & (50 * F.col("n_symbols") <= n), some & (10 * F.col("n_symbols") > n)),
        "lines": vote((lines >= 2) & (F.col("n_dup_lines") == 0), 10 * F.col("n_dup_lines") > 3 * lines),
        "repeats": vote(some & (20 * F.col("n_repeat_words") <= n), 100 * F.col("n_repeat_words") > 30 * n),
        "stutter": vote(some & (20 * F.col("n_again") <= n), 10 * F.col("n_again") > 3 * n),
        "letters": vote(some & (10 * F.col("n_lettered") >= 9 * n), some & (10 * F.col("n_lettered") < 7 * n)),
        "plain": vote(some & (10 * F.col("n_plain") >= 9 * n), some & (10 * F.col("n_plain") < 7 * n)),
        "capitals": vote(some & (20 * F.col("n_upper") <= 3 * chars), some & (10 * F.col("n_upper") > 4 * chars)),
    }


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def total(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, parts)


def odds(votes: Column, model: Column, n_rules: int, of: str) -> Column:
    """Log probability of an array of votes and of the class ``of`` ("good" or "bad"), abstentions apart."""
    out = F.ln(model["pi"] if of == "good" else 1 - model["pi"])
    for r in range(n_rules):
        rate, v = F.get(model[of], F.lit(r)), F.get(votes, F.lit(r))
        out += F.when(v > 0, F.ln(rate)).when(v < 0, F.ln(1 - rate)).otherwise(F.lit(0.0))
    return out


def posterior(votes: Column, model: Column, n_rules: int) -> Column:
    """Probability of "good" for an array of votes under a model (pi, good, bad)."""
    return 1 / (1 + F.exp(odds(votes, model, n_rules, "bad") - odds(votes, model, n_rules, "good")))


def likelihood(patterns: Column, model: Column, n_rules: int) -> Column:
    """Log likelihood of all patterns (votes, n)."""

    def one(p: Column) -> Column:
        a, b = odds(p["votes"], model, n_rules, "good"), odds(p["votes"], model, n_rules, "bad")
        return p["n"] * (F.greatest(a, b) + F.log1p(F.exp(-F.abs(a - b))))

    return F.aggregate(F.transform(patterns, one), F.lit(0.0), lambda a, x: a + x)


def fit(patterns: DataFrame, n_rules: int, rounds: int = ROUNDS) -> DataFrame:
    """One row (patterns, model): the vote patterns with their counts, and the fitted model.

    ``patterns`` has (votes, n), at most 3 ** n_rules rows. A good vote is never evidence against
    a document: each rule's rate of good votes on bad documents is held at or below that on good.
    The estimate is made from each of STARTS, and the likeliest is kept. Without patterns the model
    is near its priors.
    """
    one = patterns.groupBy().agg(F.sort_array(F.collect_list(F.struct("votes", F.col("n").cast("double").alias("n")))).alias("patterns"))
    starts = [F.struct(F.lit(pi).alias("pi"), F.array(*[F.lit(a)] * n_rules).alias("good"), F.array(*[F.lit(b)] * n_rules).alias("bad")) for pi, a, b in STARTS]

    def better(model: Column) -> Column:
        weighed = F.transform("patterns", lambda p: F.struct(p["votes"].alias("v"), p["n"].alias("n"), posterior(p["votes"], model, n_rules).alias("q")))
        return F.transform(F.array(weighed), maximise)[0]

    def maximise(weighed: Column) -> Column:
        def mass(weight) -> Column:
            return F.aggregate(weighed, F.lit(0.0), lambda acc, p: acc + weight(p))

        def rate(r: int, share, prior) -> Column:
            good = mass(lambda p: F.when(F.get(p["v"], F.lit(r)) > 0, share(p)).otherwise(F.lit(0.0)))
            voted = mass(lambda p: F.when(F.get(p["v"], F.lit(r)) != 0, share(p)).otherwise(F.lit(0.0)))
            return (good + prior[0]) / (voted + sum(prior))

        def yes(p: Column) -> Column:
            return p["n"] * p["q"]

        def no(p: Column) -> Column:
            return p["n"] * (1 - p["q"])

        good = [rate(r, yes, PRIOR_GOOD) for r in range(n_rules)]
        bad = [F.least(rate(r, no, PRIOR_BAD), good[r]) for r in range(n_rules)]
        pi = (mass(yes) + PRIOR_CLASS[0]) / (mass(lambda p: p["n"]) + sum(PRIOR_CLASS))
        return F.struct(pi.alias("pi"), F.array(*good).alias("good"), F.array(*bad).alias("bad"))

    begun = one.select("patterns", F.posexplode(F.array(*starts)).alias("nr", "start"))
    ended = begun.withColumn("model", F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), F.col("start"), lambda model, _: better(model)))
    likely = F.struct(likelihood(F.col("patterns"), F.col("model"), n_rules), -F.col("nr"))
    return kept(ended.groupBy().agg(F.max_by(F.struct("patterns", "model"), likely).alias("best")).select("best.*"))


def judge(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, the BASE counts, base_failed, quality (posterior) and kept, per row of ``docs``.

    Accuracies are estimated on documents that pass the base rule, as the others are decided, and
    their junk would be taken for all that is bad. The counts are written once, then read for the vote patterns and for the verdicts. Null and
    empty texts have no words, fail the base rule and aren't kept; repeated rows are judged alike;
    other columns are not used. An empty table gives no rows. The table of patterns that is
    broadcast has at most 3 ** 9 = 19,683 rows, whatever the input.
    """
    votes = rules()
    counted = measures(docs.select("doc_id", "text")).drop("text").withColumn("votes", F.array(*votes.values()))
    counted = kept(counted.select("doc_id", *BASE, "votes"))
    open_cases = F.count(F.when(~base_failed(), 1)).alias("n")
    fitted = fit(counted.groupBy("votes").agg(open_cases), len(votes), rounds)
    each = fitted.select("model", F.explode("patterns").alias("p"))
    verdicts = kept(each.select(F.col("p.votes").alias("pattern"), posterior(F.col("p.votes"), F.col("model"), len(votes)).alias("quality")))
    joined = counted.join(F.broadcast(verdicts), counted["votes"] == verdicts["pattern"], "left")
    good = ~base_failed() & (F.col("quality") >= 0.5)
    return joined.select("doc_id", *BASE, base_failed().alias("base_failed"), good.alias("kept"), "quality")
