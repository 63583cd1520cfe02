"""Recall-targeted plan of a hybrid query, chosen on the driver before the DataFrame is built."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values: (recall target at least, margin, effort).
STEPS = ((0.99, 12.0, 256), (0.95, 7.0, 192), (0.90, 4.5, 128), (0.80, 2.5, 64), (0.0, 1.5, 64))
LEAST_SELECTIVITY, MOST_OVER_FETCH = 1e-4, 4096

#: Assumed when nothing is known of a filter.
UNKNOWN_SELECTIVITY = 0.5


@dataclass(frozen=True)
class Plan:
    over_fetch: int
    ef: int
    est_selectivity: float
    est_candidates: int


def step(target: float) -> tuple[float, int]:
    """(margin, effort) of a recall target."""
    return next(((m, e) for least, m, e in STEPS if target >= least), STEPS[-1][1:])


def plan(selectivity: float, k: int, target: float) -> Plan:
    """Enough candidates that k of them can be expected to pass the filter, times a margin."""
    sel = min(max(selectivity, LEAST_SELECTIVITY), 1.0)
    margin, effort = step(target)
    over_fetch = min(max(math.ceil(margin / sel), 1), MOST_OVER_FETCH)
    return Plan(over_fetch, effort, sel, k * over_fetch)


def plan_columns(selectivity: Column, k: Column, target: Column) -> dict[str, Column]:
    """``plan`` as Columns."""
    sel = F.least(F.greatest(selectivity.cast("double"), F.lit(LEAST_SELECTIVITY)), F.lit(1.0))
    margin, effort = F.lit(STEPS[-1][1]), F.lit(STEPS[-1][2])
    for least, m, e in reversed(STEPS[:-1]):
        margin, effort = F.when(target >= least, F.lit(m)).otherwise(margin), F.when(target >= least, F.lit(e)).otherwise(effort)
    over_fetch = F.least(F.greatest(F.ceil(margin / sel), F.lit(1)), F.lit(MOST_OVER_FETCH)).cast("long")
    return {"over_fetch": over_fetch, "ef": effort.cast("long"), "est_selectivity": sel, "est_candidates": (k * over_fetch).cast("long")}
