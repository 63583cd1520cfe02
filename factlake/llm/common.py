"""Column helpers that the operators of this subpackage share, and where results are kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import BROADCAST_ROWS, kept, read, shared_folder, stored

#: White space as the word rule sees it: space, tab, line feed, vertical tab, form feed, return.
SPACES = r"[\x20\x09-\x0D]+"

__all__ = ["BROADCAST_ROWS", "fresh", "kept", "read", "shared_folder", "shingles", "sized_join", "stored", "whole", "words"]


def whole(text: Column | str) -> Column:
    """The text, with null as the empty string."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def words(text: Column | str) -> Column:
    """Runs of characters other than white space; no words for a null or blank text."""
    return F.array_remove(F.split(whole(text), SPACES, -1), "")


def shingles(tokens: Column, k: int) -> Column:
    """Array of structs of ``k`` fields "0", "1", ...: each run of k words, repeats included.

    Fewer than k words give one struct whose last fields are null; no words give an empty array.
    """
    n = F.greatest(F.size(tokens) - (k - 1), F.lit(1))
    return F.arrays_zip(*[F.slice(tokens, i + 1, n).alias(str(i)) for i in range(k)])


def sized_join(left: DataFrame, right: DataFrame, on, how: str, rows: int) -> DataFrame:
    """Join ``right`` of ``rows`` counted rows: broadcast within BROADCAST_ROWS, shuffled beyond."""
    return left.join(F.broadcast(right) if rows <= BROADCAST_ROWS else right, on, how)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names for internal use that ``df`` doesn't have (Spark compares without case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out
