"""Toxicity by a bidirectional gated recurrent network with attention pooling, in numpy.

A text is cut into overlapping windows of words. A word's input is the vector of the word plus the
mean of the vectors of its character n-grams (both hashed, all learned from a random start). Two
gated recurrent units read the window from either side, attention weighs their states, and a
window's score is the logistic of the weighted sum. A text is as toxic as its most toxic window.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, whole
from .quality_crf import pieces
from .samples import fold, labelled

#: Bounds of the sample that the network is fitted on.
TRAIN_TOXIC, TRAIN_CLEAN, TRAIN_CHARS = 1200, 2500, 12_000
THRESHOLD = 0.3

WINDOW, STRIDE = 32, 8
D, H, A = 12, 12, 12
WORD_ROWS, GRAM_ROWS = 1 << 16, 1 << 18
GRAMS = (3, 4, 5, 6)

#: How sharply the windows of a toxic text are drawn by their odds, phase by phase, and the share of
#: the full steps that are taken. At first any window stands for its text, at last only the most
#: toxic one does.
PHASES = ((0.0, 1.0), (1.0, 1.0), (1.0, 1.0), (2.0, 1.0), (4.0, 1.0), (HARD := 100.0, 1.0), (HARD, 0.4), (HARD, 0.1))

#: Windows drawn of a toxic text in a round, texts in a step, and the steps that a phase has at
#: least: a small sample is read in several rounds a phase.
DRAWS, STEP, LEAST_STEPS = 4, 128, 40

#: Every how many words a window is taken while fitting.
FIT_STRIDE = 16

#: Share of words whose own vector is left out of a fitting step, so that n-grams must do.
DROPPED = 0.5
EDGE = ".,;:!?\"'()[]{}«»„“”…-*#%&$|<>"

#: Step of the vectors' largest change. All rows share the scale, so rare words and n-grams, with
#: their small gradients, move little and frequent ones decide.
PACE = 0.6

#: Step of the other parameters, and their pull towards 0.
RATE, DECAY = 0.01, 1e-4

#: Words that one worker remembers; beyond it the memory starts anew.
REMEMBERED = 100_000

#: Windows that are read at once: their states fit in a core's cache.
BATCH = 1024


def split(text: str) -> list[str]:
    return text.lower().split()


def rows_of(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of each word, rows of all its n-grams one word after the other, number of n-grams of
    each word). The n-grams are those of the word without marks at its edges, between < and >."""
    if not words:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    bare = [w.strip(EDGE) or w for w in words]
    word_rows = np.array([zlib.crc32(w.encode("utf-8", "replace")) for w in bare]) % WORD_ROWS
    size = np.array([len(w) + 2 for w in bare])
    points = np.frombuffer(f"<{'><'.join(bare)}>".encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    left = np.repeat(np.cumsum(size), size) - np.arange(len(points))
    hashes, fits = np.empty((len(points), len(GRAMS)), np.uint32), np.empty((len(points), len(GRAMS)), bool)
    padded = np.concatenate([points, np.zeros(max(GRAMS), np.uint32)])
    for k, n in enumerate(GRAMS):
        h = np.full(len(points), n, np.uint32)
        for i in range(n):
            h = (h ^ padded[i : i + len(points)]) * np.uint32(0x9E3779B1)
            h ^= h >> np.uint32(15)
        hashes[:, k], fits[:, k] = h % np.uint32(GRAM_ROWS), left >= n
    return word_rows, hashes[fits].astype(np.int32), np.add.reduceat(fits.sum(1), np.cumsum(size) - size)


def logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def bent(x: np.ndarray) -> np.ndarray:
    """tanh, through exp, which numpy computes faster in single precision."""
    return 2 / (1 + np.exp(-2 * x)) - 1


def window_starts(n_words: np.ndarray, stride: int = STRIDE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, first word in the text, number of windows of each text); every text has one at least."""
    n = np.maximum(1, -(-(n_words - WINDOW) // stride) + 1)
    text = np.repeat(np.arange(len(n)), n)
    return text, (np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)) * stride, n


class Network:
    """Parameters, inputs of words, and the pass over windows."""

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)

        def start(*shape: int, scale: float) -> np.ndarray:
            return (r.standard_normal(shape) * scale).astype(np.float32)

        self.p = {"words": start(WORD_ROWS, D, scale=0.01), "grams": start(GRAM_ROWS, D, scale=0.01)}
        for side in "fb":
            self.p |= {f"x{side}": start(D, 3 * H, scale=D**-0.5), f"h{side}": start(H, 3 * H, scale=H**-0.5), f"c{side}": np.zeros(3 * H, np.float32)}
        self.p |= {"u": start(2 * H, A, scale=0.3), "v": start(A, scale=0.3), "o": start(2 * H, scale=0.3), "k": np.full(1, -1.0, np.float32)}

    def vectors(self, word_rows: np.ndarray, grams: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Inputs of words from their rows."""
        out, ends = np.empty((len(sizes), D), np.float32), np.cumsum(sizes)
        for i in range(0, len(sizes), BATCH):  # an n-gram's vector is as large as a word's
            part = slice(i, i + BATCH)
            first, size = ends[part] - sizes[part], sizes[part]
            sums = np.add.reduceat(self.p["grams"][grams[first[0] : ends[part][-1]]], first - first[0], axis=0)
            out[part] = self.p["words"][word_rows[part]] + sums / size[:, None].astype(np.float32)
        return out

    def gates(self, vectors: np.ndarray) -> dict[str, np.ndarray]:
        """What each word adds to the gates of either side; a row for "no word" comes first."""
        padded = np.concatenate([np.zeros((1, D), np.float32), vectors])
        return {side: padded @ self.p[f"x{side}"] + self.p[f"c{side}"] for side in "fb"}

    def read(self, windows: np.ndarray, gates: dict[str, np.ndarray], keep: bool = False):
        """Log odds of toxic per window; ``windows`` holds rows of ``gates``, 0 where no word is."""
        n, p = len(windows), self.p
        states = np.zeros((WINDOW, n, 2 * H), np.float32)
        saved: dict[str, list] = {"f": [None] * WINDOW, "b": [None] * WINDOW}
        word = windows.T.copy()
        absent = word == 0
        empty, some = absent.all(1), absent.any(1)
        for side, steps in (("f", range(WINDOW)), ("b", range(WINDOW - 1, -1, -1))):
            h, weights, part = np.zeros((n, H), np.float32), p[f"h{side}"], slice(0, H) if side == "f" else slice(H, None)
            for t in steps:
                if empty[t]:
                    continue
                x, turned = gates[side].take(word[t], 0), h @ weights
                zr = logistic(x[:, : 2 * H] + turned[:, : 2 * H])
                z, r = zr[:, :H], zr[:, H:]
                if some[t]:
                    z[absent[t]] = 1
                new = bent(x[:, 2 * H :] + r * turned[:, 2 * H :])
                if keep:
                    saved[side][t] = (h, z, r, new, turned[:, 2 * H :])
                h = new + z * (h - new)
                states[t, :, part] = h
        lit = bent(states @ p["u"])
        pull = lit @ p["v"]
        pull[absent] = -30
        pull = np.exp(pull - pull.max(0))
        weight = pull / pull.sum(0)
        pooled = np.einsum("tn,tnh->nh", weight, states)
        odds = pooled @ p["o"] + p["k"]
        return (odds, (word, absent, states, saved, lit, weight, pooled)) if keep else odds

    def slopes(self, loss: np.ndarray, kept, vectors: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Gradients of the parameters above the inputs, and of the words' inputs."""
        word, absent, states, saved, lit, weight, pooled = kept
        p, g = self.p, {}
        g["o"], g["k"] = pooled.T @ loss, np.array([loss.sum()], np.float32)
        back = loss[:, None] * p["o"]
        d_weight = np.einsum("tnh,nh->tn", states, back)
        d_states = weight[:, :, None] * back
        d_pull = weight * (d_weight - (weight * d_weight).sum(0))
        d_pull[absent] = 0
        g["v"] = np.einsum("tna,tn->a", lit, d_pull)
        d_lit = d_pull[:, :, None] * p["v"] * (1 - lit**2)
        g["u"] = np.einsum("tnh,tna->ha", states, d_lit)
        d_states += d_lit @ p["u"].T
        padded = np.concatenate([np.zeros((1, D), np.float32), vectors])
        d_vectors = np.zeros_like(padded)
        for side, steps in (("f", range(WINDOW - 1, -1, -1)), ("b", range(WINDOW))):
            part = slice(0, H) if side == "f" else slice(H, None)
            d_h, d_gates = 0, np.zeros((*word.shape, 3 * H), np.float32)
            g[f"h{side}"] = np.zeros_like(p[f"h{side}"])
            for t in steps:
                if saved[side][t] is None:
                    continue
                h, z, r, new, turned = saved[side][t]
                d = d_states[t, :, part] + d_h
                d_new = d * (1 - z) * (1 - new**2)
                d_z = d * (h - new) * z * (1 - z)
                d_r = d_new * turned * r * (1 - r)
                d_turned = np.concatenate([d_z, d_r, d_new * r], axis=1)
                d_gates[t] = np.concatenate([d_z, d_r, d_new], axis=1)
                g[f"h{side}"] += h.T @ d_turned
                d_h = d * z + d_turned @ p[f"h{side}"].T
            flat = d_gates.reshape(-1, 3 * H)
            g[f"c{side}"] = flat.sum(0)
            g[f"x{side}"] = padded[word.ravel()].T @ flat
            to = flat @ p[f"x{side}"].T
            order = np.argsort(word.ravel(), kind="stable")
            ids, first = np.unique(word.ravel()[order], return_index=True)
            d_vectors[ids] += np.add.reduceat(to[order], first, axis=0)
        return g, d_vectors[1:]


class Reader:
    """Scores texts; remembers the gates of words it has met."""

    def __init__(self, network: Network, remembered: float = REMEMBERED):
        self.network, self.remembered = network, remembered
        self.forget()

    def forget(self) -> None:
        self.rows: dict[str, int] = {}
        self.gates = self.network.gates(np.empty((0, D), np.float32))

    def numbers(self, words: list[str]) -> np.ndarray:
        if len(self.rows) > self.remembered:
            self.forget()
        rows, new = self.rows, []
        out = np.fromiter(map(rows.get, words, [0] * len(words)), dtype=np.int64, count=len(words))
        for i in np.flatnonzero(out == 0):
            word = words[i]
            if word not in rows:
                rows[word] = len(rows) + 1
                new.append(word)
            out[i] = rows[word]
        if new:
            more = self.network.gates(self.network.vectors(*rows_of(new)))
            self.gates = {side: np.concatenate([self.gates[side], more[side][1:]]) for side in "fb"}
        return out

    def windows(self, texts: list[str], stride: int = STRIDE) -> tuple[np.ndarray, np.ndarray]:
        """(windows as word numbers, number of windows of each text)."""
        words = [split(t) for t in texts]
        n_words = np.array([len(w) for w in words], dtype=np.int64)
        numbers = np.append(self.numbers([w for ws in words for w in ws]), 0)
        text, start, n = window_starts(n_words, stride)
        at = start[:, None] + np.arange(WINDOW)
        first = (np.cumsum(n_words) - n_words)[text]
        return numbers[np.where(at < n_words[text][:, None], first[:, None] + at, len(numbers) - 1)], n

    def odds(self, windows: np.ndarray) -> np.ndarray:
        return np.concatenate([self.network.read(windows[i : i + BATCH], self.gates) for i in range(0, len(windows), BATCH)])

    def score(self, texts: list[str]) -> np.ndarray:
        """Toxicity of each text in 0 to 1: that of its most toxic window."""
        windows, n = self.windows(texts)
        most = np.maximum.reduceat(self.odds(windows), np.cumsum(n) - n)
        return logistic(most.astype(np.float64))


def drawn(odds: np.ndarray, first: np.ndarray, n: np.ndarray, sharpness: float, r: np.random.Generator) -> np.ndarray:
    """One window of each text, by chance in proportion to exp(sharpness * odds); the most toxic one
    if ``sharpness`` is HARD."""
    pull = odds if sharpness >= HARD else odds * sharpness + r.gumbel(size=len(odds))
    order = np.lexsort((pull, np.repeat(np.arange(len(n)), n)))
    return order[first + n - 1]


def fit(texts: list[str], labels: np.ndarray, phases: tuple[tuple[float, float], ...] = PHASES, seed: int = 7) -> Network:
    """Fitted from a random start on windows drawn of toxic texts, and on the most toxic window so
    far and a random one of clean texts.

    A text's label says that some window of it is toxic, not which. So windows are drawn at first
    by chance: what toxic windows have in common raises their odds, and they are drawn the more.
    Toxic windows weigh as much as all clean ones; the bias takes the weight back at the end.
    Without texts of both kinds the network is as it starts, and scores are nearly alike for all.
    """
    network, r = Network(seed), np.random.default_rng(seed)
    toxic = labels == 1
    if not toxic.any() or toxic.all():
        return network
    words = sorted({w for t in texts for w in split(t)})
    parts = [rows_of(words[i : i + 40_000]) for i in range(0, len(words), 40_000)] or [rows_of([])]
    word_rows, flat, sizes = (np.concatenate(x) for x in zip(*parts, strict=True))
    ends = np.cumsum(sizes)
    reader = Reader(network, remembered=float("inf"))  # the sample is bounded
    reader.rows = {w: i + 1 for i, w in enumerate(words)}
    reader.gates = {side: np.zeros((len(words) + 1, 3 * H), np.float32) for side in "fb"}
    parts = [reader.windows(part, FIT_STRIDE) for part in pieces(texts, 1_000_000)]
    windows, n = np.concatenate([w.astype(np.int32) for w, _ in parts]), np.concatenate([k for _, k in parts])
    first = np.cumsum(n) - n
    del parts

    def grams_of(some_words: np.ndarray) -> np.ndarray:
        """Rows of the n-grams of the words, one word after the other."""
        size = sizes[some_words]
        shift = np.repeat(ends[some_words] - np.cumsum(size), size)
        return flat[np.arange(len(shift)) + shift]

    above = [k for k in network.p if k not in ("words", "grams")]
    m = {k: np.zeros_like(network.p[k]) for k in above}
    v = {k: np.zeros_like(network.p[k]) for k in above}
    scale, step = {"words": 0.0, "grams": 0.0}, 0

    def learn_from(windows: np.ndarray, truth: np.ndarray, weight: np.ndarray, share: float) -> None:
        """One step of descent, or a share of one."""
        nonlocal step
        ids, local = np.unique(windows, return_inverse=True)
        none = ids[0] == 0
        used = ids[1:] - 1 if none else ids - 1
        local = local.reshape(windows.shape) + (0 if none else 1)
        grams = grams_of(used)
        some = sizes[used]
        seen = (r.random(len(used)) >= DROPPED).astype(np.float32)[:, None]
        vectors = network.vectors(word_rows[used], grams, some) - (1 - seen) * network.p["words"][word_rows[used]]
        odds, kept = network.read(local, network.gates(vectors), keep=True)
        loss = ((logistic(odds) - truth) * weight / len(truth)).astype(np.float32)
        g, d_vectors = network.slopes(loss, kept, vectors)
        step += 1
        rate = share * RATE * np.sqrt(1 - 0.99**step) / (1 - 0.9**step)
        for k, slope in g.items():
            slope = slope + DECAY * network.p[k]
            m[k] = 0.9 * m[k] + 0.1 * slope
            v[k] = 0.99 * v[k] + 0.01 * slope**2
            network.p[k] -= (rate * m[k] / (np.sqrt(v[k]) + 1e-8)).astype(np.float32)
        for k, at, slope in (("words", word_rows[used], seen * d_vectors), ("grams", grams, np.repeat(d_vectors / some[:, None], some, axis=0))):
            sorted_at = np.argsort(at, kind="stable")
            hit, begin = np.unique(at[sorted_at], return_index=True)
            if not len(hit):
                continue
            slope = np.add.reduceat(slope[sorted_at], begin, axis=0)
            scale[k] = max(1e-12, 0.98 * scale[k] + 0.02 * float((slope**2).sum(1).max())) if step > 1 else max(1e-12, float((slope**2).sum(1).max()))
            network.p[k][hit] -= (share * PACE * slope / np.sqrt(scale[k])).astype(np.float32)

    odds = np.zeros(len(windows), np.float32)
    for phase, (sharp, share) in enumerate(phases):
        taken = 0
        while taken < LEAST_STEPS:
            if phase or taken:
                reader.gates = {}  # the old ones go first: both would be most of the driver's memory here
                reader.gates = network.gates(network.vectors(word_rows, flat, sizes))
                odds = reader.odds(windows)
            bad = [drawn(odds, first, n, sharp, r)[toxic] for _ in range(1 if sharp >= HARD else DRAWS)]
            chance = first + r.integers(0, 1 << 30, len(texts)) % n
            good = [chance[~toxic], drawn(odds, first, n, HARD, r)[~toxic]]
            chosen = np.concatenate(bad + good)
            truth = np.arange(len(chosen)) < sum(map(len, bad))
            balance = (len(chosen) - truth.sum()) / truth.sum()
            order = r.permutation(len(chosen))
            for part in np.array_split(order, max(1, len(order) // STEP)):
                learn_from(windows[chosen[part]], truth[part], np.where(truth[part], balance, 1), share)
                taken += 1
    network.p["k"] -= np.float32(np.log(balance))
    return network


def score(docs: DataFrame, network: Network, column: str = "score") -> DataFrame:
    """``docs`` with a score of every whole text, 0 to 1, in a new column.

    Null and empty texts have one window without words and get its score; equal texts get equal
    scores; an empty table stays empty. All columns stay, but one that is called ``column`` (in any
    case of letters) already is replaced.
    """
    sent = docs.sparkSession.sparkContext.broadcast(network)

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        reader = Reader(sent.value)
        for batch in batches:
            parts = [reader.score(part) for part in pieces(batch.tolist(), 1_000_000)]
            yield pd.Series(np.concatenate(parts) if parts else np.empty(0))

    return docs.withColumn(column, scored(whole("text")))


def learn(docs: DataFrame, labels: DataFrame) -> Network:
    """Fitted on labelled ``docs``; rows with crc32(doc_id) mod 4 = 2 are held out."""
    rows = labelled(docs, labels, "toxic", fold(4) != 2, {1: TRAIN_TOXIC, 0: TRAIN_CLEAN}, TRAIN_CHARS)
    return fit(rows["text"].tolist(), rows["label"].to_numpy(dtype=np.int64))


def drop_toxic(docs: DataFrame, labels: DataFrame, most: float = THRESHOLD) -> DataFrame:
    """Rows of ``docs`` whose toxicity is below ``most``; all columns stay."""
    (name,) = fresh(docs, "gru_toxicity")
    return score(docs, learn(docs, labels), name).where(F.col(name) < most).drop(name)
