"""Quality by a linear-chain conditional random field over lines.

Each line is good or bad. Its features are counts and ratios of the line and of the lines before
and after it, cut into bins; the field has a weight for each bin and one for each pair of
neighbouring labels. Forward-backward gives each line's probability of being good, and a document's
quality is their mean, weighted by line length. Documents' labels are taken as labels of all their
lines for fitting.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, whole
from .samples import fold, labelled

#: Bounds of the sample that the field is fitted on.
TRAIN_GOOD, TRAIN_BAD, TRAIN_CHARS = 2000, 1000, 20_000
BINS = 8
STEPS = 150

#: Code points of one piece of work, unless one text is longer.
PIECE = 2_000_000

LOWER, CAPITAL, DIGIT, SPACE, STOP, BAR, LOUD, SIGN, BREAK, OTHER = range(10)
FEATURES = 17


def char_classes() -> np.ndarray:
    """Class of each code point below 65536."""
    kinds = {"Ll": LOWER, "Lo": LOWER, "Lm": LOWER, "Lu": CAPITAL, "Lt": CAPITAL, "Nd": DIGIT, "Zs": SPACE}
    table = np.full(65536, OTHER, dtype=np.uint8)
    for c in range(65536):
        kind = unicodedata.category(chr(c))
        table[c] = kinds.get(kind, SIGN if kind[0] == "S" else STOP if kind[0] == "P" else OTHER)
    for chars, kind in (("\t\v\f\r", SPACE), ("|", BAR), ("!?", LOUD), ("#*%&@_\\/<>[]{}", SIGN), ("\n", BREAK)):
        for c in chars:
            table[ord(c)] = kind
    return table


CLASSES: list[np.ndarray] = []


def line_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features of each line, length of each line, number of lines of each text)."""
    if not CLASSES:
        CLASSES.append(char_classes())
    joined = "\n".join(texts) + "\n"
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    kinds = CLASSES[0][np.minimum(points, 65535)]
    ends = np.flatnonzero(kinds == BREAK)
    starts = np.concatenate([[0], ends[:-1] + 1])
    length = (ends - starts).astype(np.float64)
    counts = np.stack([np.add.reduceat(kinds == k, starts, dtype=np.int64) for k in range(OTHER)])
    gap = (kinds == SPACE) | (kinds == BREAK)
    begins = ~gap
    begins[1:] &= gap[:-1]
    n_words = np.add.reduceat(begins, starts, dtype=np.int64).astype(np.float64)
    distinct, again, n_lines = np.empty(len(ends)), np.zeros(len(ends)), np.empty(len(texts), dtype=np.int64)
    at = 0
    for d, text in enumerate(texts):
        seen: set[str] = set()
        lines = text.split("\n")
        n_lines[d] = len(lines)
        for line in lines:
            distinct[at] = len(set(line.split()))
            again[at] = line in seen and not (not line or line.isspace())
            seen.add(line)
            at += 1
    size, some = np.maximum(length, 1), np.maximum(n_words, 1)
    first, last = kinds[starts], kinds[np.maximum(ends - 1, starts)]
    features = np.stack(
        [
            np.log1p(length),
            np.log1p(n_words),
            counts[LOWER] / size,
            counts[CAPITAL] / size,
            counts[DIGIT] / size,
            counts[SPACE] / size,
            counts[STOP] / some,
            counts[BAR] / some,
            counts[LOUD] / some,
            counts[SIGN] / some,
            (length - counts[:OTHER].sum(0)) / size,
            (length - counts[SPACE]) / some,
            distinct / some,
            distinct / np.sqrt(some),
            again,
            first == CAPITAL,
            last == STOP,
        ],
        axis=1,
    )
    return features, length, n_lines


def with_neighbours(bins: np.ndarray, n_lines: np.ndarray) -> np.ndarray:
    """Bins of the line, the one before and the one after; BINS where there is none."""
    first = np.cumsum(n_lines) - n_lines
    before, after = np.roll(bins, 1, axis=0), np.roll(bins, -1, axis=0)
    before[first], after[first + n_lines - 1] = BINS, BINS
    return np.concatenate([bins, before, after], axis=1)


def forward_backward(lean: np.ndarray, n_lines: np.ndarray, ties: np.ndarray, pairs: bool = False):
    """Probability of good for each line, and with ``pairs`` the expected label pairs per text.

    ``lean`` is each line's log odds of good by its features, ``ties`` the 2 x 2 log weights of
    neighbouring labels (bad is 0). All texts go a line further together, the longest first.
    """
    n, first = len(lean), np.cumsum(n_lines) - n_lines
    order = np.argsort(-n_lines, kind="stable")
    starts, sizes = first[order], n_lines[order]
    going = np.searchsorted(-sizes, -np.arange(sizes[0] if len(sizes) else 0), side="left")
    half = np.clip(lean, -40, 40) / 2
    own = np.exp(np.stack([-half, half], axis=1))
    t = np.exp(ties)
    ahead, back = np.empty((n, 2)), np.ones((n, 2))
    for step, k in enumerate(going):
        at = starts[:k] + step
        a = own[at] if step == 0 else (ahead[at - 1] @ t) * own[at]
        ahead[at] = a / a.sum(1, keepdims=True)
    for step in range(len(going) - 2, -1, -1):
        at = starts[: going[step + 1]] + step
        b = (own[at + 1] * back[at + 1]) @ t.T
        back[at] = b / b.sum(1, keepdims=True)
    both = ahead * back
    good = both[:, 1] / both.sum(1)
    if not pairs:
        return good
    texts = np.repeat(np.arange(len(n_lines)), n_lines)
    inner = np.ones(n, dtype=bool)
    inner[first + n_lines - 1] = False
    at = np.flatnonzero(inner)
    xi = ahead[at][:, :, None] * t * (own[at + 1] * back[at + 1])[:, None, :]
    xi /= xi.sum((1, 2), keepdims=True)
    return good, xi, texts[at]


@dataclass
class Field:
    """Bin edges of the features, weights of their bins, weights of label pairs, and a constant."""

    edges: np.ndarray
    weights: np.ndarray
    ties: np.ndarray
    base: float

    def lean(self, bins: np.ndarray) -> np.ndarray:
        out = np.full(len(bins), self.base)
        for f in range(bins.shape[1]):
            out += self.weights[f][bins[:, f]]
        return out

    def bins(self, features: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(self.edges[f], features[:, f], side="right") for f in range(FEATURES)], axis=1).astype(np.int8)

    def score(self, texts: list[str]) -> np.ndarray:
        """Quality of each text in 0 to 1. A line counts by its length plus 1, so empty texts have one too."""
        features, length, n_lines = line_features(texts)
        good = forward_backward(self.lean(with_neighbours(self.bins(features), n_lines)), n_lines, self.ties)
        first = np.cumsum(n_lines) - n_lines
        return np.add.reduceat(good * (length + 1), first) / np.add.reduceat(length + 1, first)


def fit(texts: list[str], labels: np.ndarray, steps: int = STEPS) -> Field:
    """The field of greatest penalised likelihood, by full-batch Adam; deterministic.

    Without texts, all lines lean neither way and every score is 0.5.
    """
    empty = Field(np.zeros((FEATURES, BINS - 1)), np.zeros((3 * FEATURES, BINS + 1)), np.zeros((2, 2)), 0.0)
    if not len(texts):
        return empty
    features, _, n_lines = line_features(texts)
    cuts = np.linspace(0, 1, BINS + 1)[1:-1]
    field = Field(np.stack([np.quantile(features[:, f], cuts) for f in range(FEATURES)]), empty.weights, empty.ties, 0.0)
    bins = with_neighbours(field.bins(features), n_lines)
    truth = np.repeat(labels.astype(np.float64), n_lines)
    share = 1 / np.sqrt(n_lines)
    share *= len(share) / share.sum()
    by_line = np.repeat(share, n_lines)
    same = np.zeros((len(texts), 2, 2))
    same[np.arange(len(texts)), labels, labels] = n_lines - 1
    flat = np.concatenate([field.weights.ravel(), field.ties.ravel(), [0.0]])
    m, v = np.zeros_like(flat), np.zeros_like(flat)
    w = field.weights.size
    for step in range(1, steps + 1):
        field.weights, field.ties, field.base = flat[:w].reshape(field.weights.shape), flat[w:-1].reshape(2, 2), float(flat[-1])
        good, xi, of = forward_backward(field.lean(bins), n_lines, field.ties, pairs=True)
        miss = (truth - good) * by_line
        by_bin = np.stack([np.bincount(bins[:, f], miss, BINS + 1) for f in range(bins.shape[1])])
        by_pair = (same * share[:, None, None]).sum(0) - (xi * share[of][:, None, None]).sum(0)
        slope = np.concatenate([by_bin.ravel(), by_pair.ravel(), [miss.sum()]]) / len(texts) - 2e-3 * flat
        m, v = 0.9 * m + 0.1 * slope, 0.99 * v + 0.01 * slope**2
        flat = flat + 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        flat[w:-1] = np.clip(flat[w:-1], -1.5, 1.5)  # lines keep a say of their own
    field.weights, field.ties, field.base = flat[:w].reshape(field.weights.shape), flat[w:-1].reshape(2, 2), float(flat[-1])
    return field


def pieces(texts: list[str], size: int = PIECE) -> Iterator[list[str]]:
    """Consecutive texts of about ``size`` code points together."""
    part, n = [], 0
    for text in texts:
        if part and n + len(text) > size:
            yield part
            part, n = [], 0
        part.append(text)
        n += len(text)
    if part:
        yield part


def score(docs: DataFrame, field: Field, column: str = "score") -> DataFrame:
    """``docs`` with a score of every whole text, 0 to 1, in a new column.

    Null and empty texts have one empty line and get its score; equal texts get equal scores; an empty
    table stays empty. All columns stay, but one that is called ``column`` (in any case of letters)
    already is replaced.
    """
    sent = docs.sparkSession.sparkContext.broadcast(field)

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            parts = [sent.value.score(part) for part in pieces(batch.tolist())]
            yield pd.Series(np.concatenate(parts) if parts else np.empty(0))

    return docs.withColumn(column, scored(whole("text")))


def learn(docs: DataFrame, labels: DataFrame) -> Field:
    """Fitted on labelled ``docs``; rows with crc32(doc_id) mod 3 = 1 are held out."""
    rows = labelled(docs, labels, "quality", fold(3) != 1, {1: TRAIN_GOOD, 0: TRAIN_BAD}, TRAIN_CHARS)
    return fit(rows["text"].tolist(), rows["label"].to_numpy(dtype=np.int64))


def drop_low_quality(docs: DataFrame, labels: DataFrame, least: float = 0.5) -> DataFrame:
    """Rows of ``docs`` whose quality reaches ``least``; all columns stay."""
    (name,) = fresh(docs, "crf_quality")
    return score(docs, learn(docs, labels), name).where(F.col(name) >= least).drop(name)
