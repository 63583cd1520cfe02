"""Bit votes of 64-bit hashes, two counters to a long.

``shiftrightunsigned(h, i) & ONES`` holds bit i of h in its low half and bit i + 32 in its high
half, so 32 sums of longs count all 64 bits exactly, for up to 2 ** 31 votes.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

ONES = (1 << 32) | 1
LOW = (1 << 32) - 1


def sums(name: str, hashed: Column, weight: Column | None = None) -> list[Column]:
    """32 aggregates ``name``0 to ``name``31; null hashes don't vote."""
    bits = [F.shiftrightunsigned(hashed, i).bitwiseAND(F.lit(ONES)) for i in range(32)]
    return [F.sum(b if weight is None else b * weight).alias(f"{name}{i}") for i, b in enumerate(bits)]


def majority(name: str, total: Column) -> Column:
    """The long whose bit is 1 where over half of ``total`` voted for it; 0 if none voted."""

    def bit(count: Column, i: int) -> Column:
        return F.when(2 * count > total, F.lit((1 << i) - (1 << 64 if i == 63 else 0))).otherwise(F.lit(0))

    low = [bit(F.col(f"{name}{i}").bitwiseAND(F.lit(LOW)), i) for i in range(32)]
    high = [bit(F.shiftrightunsigned(F.col(f"{name}{i}"), 32), i + 32) for i in range(32)]
    return reduce(lambda a, b: a.bitwiseOR(b), low + high)


def hex64(value: Column) -> Column:
    """16 lowercase hexadecimal digits of a long, as unsigned."""
    return F.lower(F.lpad(F.hex(value), 16, "0"))
