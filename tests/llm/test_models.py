"""Fitted operators: held-out accuracy, gradients and recursions against brute force; BPE against the library."""

import itertools
import math
import random
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from factlake.llm import bpe, quality_crf, samples, toxicity

tokenizers = pytest.importorskip("tokenizers")
pytest.importorskip("public_tokenizers")

ODD = [None, "", " \n\t", "one", "é́ 🙂\n\nx", "w " * 40_000, "<|endoftext|>a"]


def sentence(r, bad=False):
    words = [r.choice(["anson", "tider", "melt", "of", "the", "urn", "erst", "lome"]) for _ in range(r.randrange(5, 20))]
    return " | ".join(words) + " ###" if bad else " ".join(words).capitalize() + "."


def corpus(n, seed):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        low, toxic = r.random() < 0.3, r.random() < 0.3
        lines = [sentence(r, low and r.random() < 0.8) for _ in range(r.randrange(1, 8))]
        if toxic:
            at = r.randrange(len(lines))
            lines[at] += " " + " ".join("zork" + r.choice(["am", "el", "ist", "ung"]) for _ in range(2))
        rows.append((i, "\n".join(lines), int(not low), int(toxic)))
    return rows


@pytest.fixture(scope="module")
def tables(spark):
    rows = corpus(900, 1)
    docs = spark.createDataFrame([(i, t) for i, t, _, _ in rows] + [(10_000 + i, t) for i, t in enumerate(ODD)] + [(None, "no id")], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, q, x) for i, _, q, x in rows] + [(None, 1, 1), (1, None, None), (10_000, 0, 0)], "doc_id bigint, quality int, toxic int")
    clashing = {n: F.lit("extra") for n in ("label", "quality", "toxic", "crf_quality", "gru_toxicity")}
    return docs.withColumns(clashing), labels, {i: (q, x) for i, _, q, x in rows}


# Linear-chain field


def brute_marginals(lean, ties):
    n, total, good = len(lean), 0.0, np.zeros(len(lean))
    for path in itertools.product((0, 1), repeat=n):
        w = np.exp(sum(lean[i] * path[i] for i in range(n)) + sum(ties[path[i], path[i + 1]] for i in range(n - 1)))
        total += w
        good += w * np.array(path)
    return good / total


def test_forward_backward_equals_enumeration():
    r = np.random.default_rng(0)
    n_lines = np.array([1, 7, 3, 3, 1, 9])
    lean, ties = r.normal(size=n_lines.sum()), r.normal(size=(2, 2))
    got = quality_crf.forward_backward(lean, n_lines, ties)
    want = np.concatenate([brute_marginals(x, ties) for x in np.split(lean, np.cumsum(n_lines)[:-1])])
    assert np.allclose(got, want)


def test_document_scores_are_weighted_means_of_line_marginals():
    """Every line by enumeration of all labellings, weighted by its length and 1."""
    r, rows = random.Random(6), corpus(60, 3)
    field = quality_crf.fit([t for _, t, _, _ in rows], np.array([q for _, _, q, _ in rows]))
    texts = ["\n".join(sentence(r, r.random() < 0.5) if r.random() < 0.9 else "" for _ in range(r.randrange(1, 8))) for _ in range(20)] + ["", "\n", "one"]
    for text, got in zip(texts, field.score(texts), strict=True):
        lines = text.split("\n")
        features, length, n_lines = quality_crf.line_features([text])
        bins = field.bins(features)
        lean = []
        for i in range(len(lines)):
            near = [bins[j] if 0 <= j < len(lines) else [quality_crf.BINS] * bins.shape[1] for j in (i, i - 1, i + 1)]
            lean.append(field.base + sum(field.weights[f][b] for f, b in enumerate(np.concatenate(near))))
        weights = np.array([len(x) + 1 for x in lines])
        assert n_lines.tolist() == [len(lines)] and abs((brute_marginals(np.array(lean), field.ties) * weights).sum() / weights.sum() - got) < 1e-9


def test_field_prefers_clean_lines_in_held_out_rows(tables):
    docs, labels, truth = tables
    out = quality_crf.score(docs, quality_crf.learn(docs, labels)).withColumn("held_out", samples.fold(3) == 1).collect()
    assert len(out) == docs.count() and all(0 <= r["score"] <= 1 for r in out)
    held = [(r["score"] >= 0.5, truth[r["doc_id"]][0]) for r in out if r["held_out"] and r["doc_id"] in truth]
    assert len(held) > 200 and np.mean([p == bool(q) for p, q in held]) > 0.95


def test_field_without_labels_or_rows(tables):
    docs, labels, _ = tables
    field = quality_crf.learn(docs, labels.limit(0))
    assert {r["score"] for r in quality_crf.score(docs.limit(5), field).collect()} == {0.5}
    assert quality_crf.drop_low_quality(docs.limit(0), labels).count() == 0
    assert quality_crf.drop_low_quality(docs, labels).columns == docs.columns


def test_only_usable_labels_are_learned_from(tables):
    docs, labels, _ = tables
    rows = samples.labelled(docs, labels, "quality", samples.fold(3) != 1, {1: 50, 0: 20}, 5000)
    assert rows["label"].value_counts().to_dict() == {1: 50, 0: 20}
    assert all(zlib.crc32(str(int(i)).encode()) % 3 != 1 for i in rows["doc_id"])
    again = samples.labelled(docs.repartition(7), labels, "quality", samples.fold(3) != 1, {1: 50, 0: 20}, 5000)
    pd.testing.assert_frame_equal(rows, again)


# Recurrent network


def test_gradients_equal_differences():
    network = toxicity.Network(3)
    r = np.random.default_rng(1)
    for k in network.p:
        network.p[k] = network.p[k].astype(np.float64)
    vectors = r.normal(size=(6, toxicity.D))
    windows = np.zeros((3, toxicity.WINDOW), dtype=np.int64)
    windows[0, :20], windows[1, :], windows[2, :1] = r.integers(1, 7, 20), r.integers(1, 7, toxicity.WINDOW), 4
    toward = r.normal(size=3)
    odds, kept = network.read(windows, network.gates(vectors), keep=True)
    slopes, d_vectors = network.slopes(toward, kept, vectors)

    def value():
        return float(toward @ network.read(windows, network.gates(vectors)))

    for k in ("xf", "xb", "hf", "hb", "cf", "cb", "u", "v", "o", "k"):
        flat = network.p[k].reshape(-1)
        for i in r.integers(0, flat.size, 4):
            was = flat[i]
            flat[i] = was + 1e-3
            up = value()
            flat[i] = was - 1e-3
            down = value()
            flat[i] = was
            assert abs((up - down) / 2e-3 - slopes[k].reshape(-1)[i]) < 2e-2 * max(1, abs(slopes[k].reshape(-1)[i])), k
    was = vectors[3, 2]
    vectors[3, 2] = was + 1e-3
    up = value()
    vectors[3, 2] = was - 1e-3
    down = value()
    vectors[3, 2] = was
    assert abs((up - down) / 2e-3 - d_vectors[3, 2]) < 2e-2


def plain_odds(network, words):
    """Log odds of one window, number by number, from the definition."""
    p, h, d = {k: v.tolist() for k, v in network.p.items()}, toxicity.H, toxicity.D
    sigma = lambda x: 1 / (1 + math.exp(-x))
    inputs = []
    for word in words:
        row, grams, _ = toxicity.rows_of([word])
        means = [sum(p["grams"][g][i] for g in grams) / len(grams) for i in range(d)]
        inputs.append([p["words"][row[0]][i] + means[i] for i in range(d)])
    states = {}
    for side in "fb":
        state, walk = [0.0] * h, list(enumerate(inputs))
        for t, x in walk if side == "f" else walk[::-1]:
            fed = [sum(x[i] * p[f"x{side}"][i][j] for i in range(d)) + p[f"c{side}"][j] for j in range(3 * h)]
            back = [sum(state[i] * p[f"h{side}"][i][j] for i in range(h)) for j in range(3 * h)]
            z = [sigma(fed[j] + back[j]) for j in range(h)]
            r = [sigma(fed[h + j] + back[h + j]) for j in range(h)]
            new = [math.tanh(fed[2 * h + j] + r[j] * back[2 * h + j]) for j in range(h)]
            state = [z[j] * state[j] + (1 - z[j]) * new[j] for j in range(h)]
            states[side, t] = state
    both = [states["f", t] + states["b", t] for t in range(len(words))]
    lit = [[math.tanh(sum(s[i] * p["u"][i][a] for i in range(2 * h))) for a in range(toxicity.A)] for s in both]
    pull = [math.exp(sum(x * y for x, y in zip(row, p["v"], strict=True))) for row in lit]
    pooled = [sum(w * s[i] for w, s in zip(pull, both, strict=True)) / sum(pull) for i in range(2 * h)]
    return sum(x * y for x, y in zip(pooled, p["o"], strict=True)) + p["k"][0]


def test_scores_equal_a_plain_forward_pass():
    network, r = toxicity.Network(5), random.Random(2)
    network.p["words"] *= 50  # far from zero, so that all parts tell
    network.p["grams"] *= 50
    texts = [" ".join(r.choice(["Anson,", "tider", "melt", "ÖF", "x", "#", "lome."]) for _ in range(n)) for n in (1, 5, 32, 33, 75)]
    got = toxicity.Reader(network).score(texts)
    for text, score in zip(texts, got, strict=True):
        words = toxicity.split(text)
        starts = [0] if len(words) <= toxicity.WINDOW else range(0, len(words) - toxicity.WINDOW + toxicity.STRIDE, toxicity.STRIDE)
        most = max(plain_odds(network, words[i : i + toxicity.WINDOW]) for i in starts)
        assert abs(1 / (1 + math.exp(-most)) - score) < 1e-4


def test_windows_overlap_and_cover():
    n_words = np.array([0, 1, 31, 32, 33, 48, 49, 200])
    text, start, n = toxicity.window_starts(n_words)
    for t, size in enumerate(n_words):
        mine = start[text == t]
        assert len(mine) == n[t] >= 1 and set(np.diff(mine)) <= {toxicity.STRIDE}
        assert mine[0] == 0 and mine[-1] + toxicity.WINDOW >= size


def test_short_runs_lie_whole_in_a_window():
    """Any run of up to 25 words, wherever it begins, is read in one piece."""
    _, start, _ = toxicity.window_starts(np.array([200]))
    for first in range(200 - 25 + 1):
        assert any(s <= first and first + 25 <= s + toxicity.WINDOW for s in start), first


def test_network_finds_toxic_stems_in_held_out_rows(tables):
    docs, labels, truth = tables
    network = toxicity.learn(docs, labels)
    out = toxicity.score(docs, network).withColumn("held_out", samples.fold(4) == 2).collect()
    assert len(out) == docs.count() and all(0 <= r["score"] <= 1 for r in out)
    held = [(r["score"] >= toxicity.THRESHOLD, truth[r["doc_id"]][1]) for r in out if r["held_out"] and r["doc_id"] in truth]
    assert len(held) > 150 and np.mean([p == bool(x) for p, x in held]) > 0.95
    reader = toxicity.Reader(network, remembered=3)  # forgetting changes nothing
    texts = [r["text"] or "" for r in out[:20]]
    assert np.allclose(np.concatenate([reader.score([t]) for t in texts]), toxicity.Reader(network).score(texts), atol=1e-5)


def test_network_without_labels_or_rows(tables):
    docs, labels, _ = tables
    assert toxicity.drop_toxic(docs.limit(0), labels).count() == 0
    network = toxicity.learn(docs, labels.limit(0))
    assert all(0 <= r["score"] <= 1 for r in toxicity.score(docs.where("doc_id >= 10000"), network).collect())


# BPE


@pytest.fixture(scope="module")
def both():
    path = bpe.installed()
    library = tokenizers.Tokenizer.from_file(path)
    library.no_truncation()
    library.no_padding()
    return bpe.WordBpe(bpe.load(path)), library


def same(both, text):
    own, library = both
    want = library.encode(text, add_special_tokens=False).ids
    n, ids, decoded = own.encode_decode(text)
    assert (n, ids) == (len(want), " ".join(map(str, want))), text
    assert decoded == library.decode(want, skip_special_tokens=False), text
    assert own.decode(own.encode(text)) == decoded


def test_bpe_equals_the_library(both):
    r = random.Random(6)
    alphabet = ["a", "th", "ing", "'s", "'LL", "Σ", "ΑΣ", "İ", "ß", "é", " ", "漢", "🙂", "½", "٣", " ", "\n", "<|endoftext|>", "<|startoftext|>", "<|end", "!!", "###", "12", "aaaaaaa", "\u0085", "가"]
    for _ in range(3000):
        same(both, "".join(r.choice(alphabet) if r.random() < 0.8 else chr(r.choice([r.randrange(32, 0x3000), r.randrange(0xE000, 0x1FFFF)])) for _ in range(r.randrange(12))))
    for _ in range(3000):
        same(both, "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randrange(1, 25))))
    same(both, "x" * 5000)
    for text in ODD:
        same(both, text or "")


def test_bpe_of_rows(spark, both):
    rows = [(i, t) for i, t in enumerate([*ODD, "twice", "twice"])] + [(None, "no id")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({"ids": F.lit("x"), "n_tokens": F.lit("y")})
    out = bpe.encode(df, bpe.installed(), keep_ids=True).collect()
    assert len(out) == len(rows)
    for r, (i, t) in zip(sorted(out, key=lambda r: (r["doc_id"] is None, r["doc_id"])), rows, strict=True):
        want = both[1].encode(t or "", add_special_tokens=False).ids
        assert (r["doc_id"], r["ids"], r["n_tokens"]) == (i, want, len(want))
        assert r["ids_sha256"] == bpe.sha(" ".join(map(str, want))) and r["decoded_sha256"] == bpe.sha(r["decoded"])
    assert bpe.encode(df.limit(0), bpe.installed()).count() == 0


def test_other_kinds_of_tokenizer_are_refused(tmp_path):
    path = tmp_path / "t.json"
    path.write_text('{"model": {"type": "BPE", "vocab": {}, "merges": [], "byte_fallback": true}, "decoder": null, "post_processor": null}')
    with pytest.raises(ValueError):
        bpe.load(str(path))
