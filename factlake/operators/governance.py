"""Access rules, masking, token budgets and audit.

deny beats mask (reads only) beats allow; nothing matching is denied. The rules compile into one
expression over (action, category, pred) of a row, so a decision needs no join.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.codecs import grain_tokens, redacted
from ..schema import ALLOW, DENY, MASK, READ
from . import sequence

Rule = tuple  # rule_id, agent, action or None, effect, match_kind, match_value


def matches(kind: str, value: int | None) -> Column:
    """Whether a fact meets a matcher; a fact without category equals no category."""
    if kind == "any":
        return F.lit(True)
    return F.coalesce(F.col("category" if kind == "category" else "pred") == value, F.lit(False))


def decision(rules: Iterable[Rule], agent: int, action: str) -> Column:
    """The decision on each row for one agent and action, from rules held on the driver."""
    effects = {ALLOW: F.lit(False), DENY: F.lit(False), MASK: F.lit(False)}
    for _, who, does, effect, kind, value in rules:
        if who == agent and does in (None, action):
            effects[effect] |= matches(kind, value)
    out = F.when(effects[DENY], F.lit(DENY))
    if action == READ:
        out = out.when(effects[MASK], F.lit(MASK))
    return out.when(effects[ALLOW], F.lit(ALLOW)).otherwise(F.lit(DENY))


def decide(requests: DataFrame, rules: DataFrame) -> DataFrame:
    """``requests`` (agent, action, category, pred, ...) with decision, for rules in a table.

    Joined by agent, which rules have few of each; a request keeps one row, as effects are
    reduced per request.
    """
    by_agent = rules.groupBy("agent").agg(F.collect_list(F.struct("action", "effect", "match_kind", "match_value")).alias("_rules"))
    joined = requests.join(by_agent, "agent", "left")

    def applies(rule: Column) -> Column:
        met = (
            F.when(rule["match_kind"] == "any", F.lit(True))
            .when(rule["match_kind"] == "category", F.col("category") == rule["match_value"])
            .otherwise(F.col("pred") == rule["match_value"])
        )
        return (rule["action"].isNull() | (rule["action"] == F.col("action"))) & F.coalesce(met, F.lit(False))

    def any_of(effect: str) -> Column:
        return F.coalesce(F.exists("_rules", lambda r: applies(r) & (r["effect"] == effect)), F.lit(False))

    found = (
        F.when(any_of(DENY), F.lit(DENY))
        .when(any_of(MASK) & (F.col("action") == READ), F.lit(MASK))
        .when(any_of(ALLOW), F.lit(ALLOW))
        .otherwise(F.lit(DENY))
    )
    return joined.withColumn("decision", found).drop("_rules")


def governed_rows(rows: DataFrame, rules: Iterable[Rule], agent: int, value: str = "val") -> DataFrame:
    """Readable rows with decision: denied ones are left out (and not replaced), masked ones redacted."""
    decided = rows.withColumn("decision", decision(rules, agent, READ)).where(F.col("decision") != DENY)
    return decided.withColumn(value, redacted(F.col("decision") == MASK, F.col(value)))


def with_cost(rows: DataFrame) -> DataFrame:
    """Rows with tokens, by the size of the value before masking."""
    return rows.withColumn("tokens", grain_tokens(F.col("val_bytes")))


def budget_ledger(queries: DataFrame, budget: int) -> DataFrame:
    """(agent, seq, cost, allowed, remaining) in order of seq: a cost above what remains is denied
    and leaves it. Ordered folding per agent; an agent's queries are gathered in one row."""
    spent = queries.groupBy("agent").agg(F.array_sort(F.collect_list(F.struct("seq", "cost"))).alias("q"))
    start = F.struct(
        F.lit(budget).cast("long").alias("left"),
        F.array().cast("array<struct<seq:bigint,cost:bigint,allowed:boolean,remaining:bigint>>").alias("out"),
    )

    def step(acc: Column, x: Column) -> Column:
        allowed = acc["left"] >= x["cost"]
        left = F.when(allowed, acc["left"] - x["cost"]).otherwise(acc["left"])
        row = F.struct(x["seq"].alias("seq"), x["cost"].alias("cost"), allowed.alias("allowed"), left.alias("remaining"))
        return F.struct(left.alias("left"), F.array_append(acc["out"], row).alias("out"))

    return spent.select("agent", F.inline(F.aggregate("q", start, step)["out"]))


def audit_of(decided: DataFrame, start: int = 0) -> DataFrame:
    """Audit rows numbered in order of ``at``: seq, agent, action, sid, pred, decision, tokens."""
    numbered = sequence.number(decided, ["at"], start=start)
    return numbered.select("seq", "agent", "action", "sid", "pred", "decision", "tokens")
