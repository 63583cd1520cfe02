"""The operators against brute force, and on rows that break things."""

import hashlib
import itertools
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from factlake.llm import chat_format, common, fingerprints, license_scan, license_texts, mixing, quality_rules, queries, simhash_dedup, url_filter
from factlake.llm.license_texts import MIT

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def prose(seed: int, n: int, vocabulary: int = 400) -> str:
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="module")
def odd_rows():
    """Nulls in every column, empty and blank texts, ties, repeated rows, a very long text."""
    long = prose(1, 30_000)
    rows = [(i, prose(i, 60), "en", f"s{i % 4}", 1) for i in range(20)]
    rows += [(20, None, None, None, None), (21, "", "en", "s0", 0), (22, " \t\n ", "en", "s1", 4), (None, "no id at all", "en", None, 3)]
    rows += [(23, "same text here now", "en", "s2", 9), (23, "same text here now", "en", "s2", 9), (24, "same text here now", "en", "s2", 9)]
    rows += [(25, long, "en", "s0", 9), (26, long[:-3] + "zzz", "en", "s0", 9), (27, "é\u0301 🙂 ß\x0bx\x85y", "fr", "s3", 1), (28, "one", "en", "s3", 3)]
    return rows


@pytest.fixture(scope="module")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def clashing(df):
    """Extra columns named as the operators' own."""
    names = ("row", "w", "h", "fp", "text_hash", "component_id", "size", "source_size", "target", "copies", "mix_copies", "dedup_hash", "score", "key", "digest", "best", "n", "k")
    return df.withColumns({n: F.lit("extra") for n in names})


def test_words_and_shingles(spark):
    row = spark.createDataFrame([("a  b\tc\u00a0d\x1ce",)], "text string").select(common.words("text").alias("w")).first()
    assert row["w"] == WORD.findall("a  b\tc\u00a0d\x1ce")


# SimHash near-dedup


def fingerprint(text):
    low = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    w = WORD.findall(low)
    parts = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(p, seed=42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints, ids, radius=3):
    parent = list(range(len(ids)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                parent[find(i)] = find(j)
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [least.get(find(i)) for i in range(len(ids))]


def test_near_duplicates_equal_brute_force(odd, odd_rows):
    got = simhash_dedup.find_near_duplicates(clashing(odd).select("doc_id", "text")).collect()
    prints = [fingerprint(r[1]) for r in odd_rows]
    want = zip([r[0] for r in odd_rows], prints, brute_components(prints, [r[0] for r in odd_rows]), strict=True)
    key = lambda x: tuple(map(str, x))
    assert sorted(((r["doc_id"], r["fp"] % 2**64, r["component_id"]) for r in got), key=key) == sorted(want, key=key)


@pytest.mark.parametrize("bucket", [30, 32_768])
def test_links_in_dense_and_hot_buckets(spark, bucket):
    """Families of fingerprints a few bits apart, with buckets split over several levels."""
    r = random.Random(5)
    prints = set()
    for _ in range(2):
        base = r.getrandbits(64)
        for _ in range(60):
            prints.add(base ^ sum(1 << b for b in r.sample(range(64), r.randrange(5))))
    prints = sorted(prints | {r.getrandbits(64) for _ in range(100)})
    ids = list(range(len(prints)))
    signed = [p - 2**64 if p >> 63 else p for p in prints]
    df = spark.createDataFrame(list(zip(ids, signed, strict=True)), "doc_id bigint, fp bigint")
    got = {x["doc_id"]: x["component_id"] for x in simhash_dedup.classes(df, bucket=bucket).collect()}
    assert [got[i] for i in ids] == brute_components(prints, ids)


def test_masks_cover_every_difference_within_the_radius():
    for level in range(3):
        masks = simhash_dedup.covering_masks(level=level)
        assert len(masks) == 15
        r = random.Random(level)
        for _ in range(300):
            gap = sum(1 << b for b in r.sample(range(64), 3))
            assert any(m & gap == 0 for m in (x % 2**64 for x in masks))


def test_components_of_a_long_chain(spark):
    n = 300
    order = random.Random(1).sample(range(n), n)
    edges = spark.createDataFrame(list(zip(order, order[1:])), "a bigint, b bigint")
    assert {(r["node"], r["root"]) for r in simhash_dedup.components(edges).collect()} == {(i, 0) for i in range(1, n)}


def test_one_document_of_each_group_stays(odd, odd_rows):
    docs = clashing(odd)
    out = simhash_dedup.drop_near_duplicates(docs)
    assert out.columns == docs.columns
    prints = [fingerprint(r[1]) for r in odd_rows]
    ids = [r[0] for r in odd_rows]
    want = sorted({c if c is not None else "none" for c in brute_components(prints, ids)}, key=str)
    assert sorted([r["doc_id"] if r["doc_id"] is not None else "none" for r in out.collect()], key=str) == want


def test_dedup_of_an_empty_table(none):
    assert simhash_dedup.drop_near_duplicates(none).count() == 0
    assert simhash_dedup.find_near_duplicates(none).count() == 0


# Document fingerprints


def test_edited_texts_and_likeness(odd, odd_rows):
    rows = [r for r in odd_rows if r[0] not in (23, None)]
    ids = {r[0] for r in rows}
    got = {r["k"]: r for r in fingerprints.fingerprint_edited(clashing(odd).where(F.col("doc_id").isin(list(ids)))).collect()}
    order = sorted(rows, key=lambda r: -r[0])
    for i, (d, text, *_) in enumerate(order):
        text, following = text or "", order[(i + 1) % len(order)][1] or ""
        took = len(text) // 3
        edited = text[: len(text) - took] + following[:took]
        r = got[d]
        sha = "".join(f"{r[f's{j}'] % 2**64:016x}" for j in range(4))
        assert (r["n_chars"], sha) == (len(text), hashlib.sha256(edited.encode()).hexdigest()), d
        if edited == text:
            assert (r["hi"], r["lo"]) == (r["ehi"], r["elo"])


def test_repeated_and_null_ids(odd, none):
    rows = fingerprints.fingerprint_edited(odd).collect()
    assert len(rows) == odd.count()
    same = {(r["hi"], r["lo"]) for r in rows if r["k"] in (23, 24)}
    assert len(same) == 1
    assert fingerprints.fingerprint_edited(none).count() == 0


def plain_simhash(text):
    """128 votes in plain Python: two hashes of each word and of each pair of neighbours."""
    w, votes = WORD.findall(text or ""), [0] * 128

    def vote(term, weight):
        one = xxhash.xxh64_intdigest(term.encode(), 42)
        two = xxhash.xxh64_intdigest((1).to_bytes(4, "little"), one)  # the hash goes on with an int
        for i in range(64):
            votes[i] += weight if one >> i & 1 else -weight
            votes[64 + i] += weight if two >> i & 1 else -weight

    for i, word in enumerate(w):
        vote(word, min(len(word), 8))
        if i + 1 < len(w):
            vote(f"{word} {w[i + 1]}", 8)
    bits = [sum(1 << i for i in range(64) if votes[at + i] > 0) for at in (0, 64)]
    return f"{bits[0]:016x}{bits[1]:016x}"


def test_simhash_equals_plain_votes(odd, odd_rows):
    rows = [r for r in odd_rows if r[0] not in (23, 25, 26)]
    prints = fingerprints.simhash(odd, ["doc_id"], "text").select("doc_id", fingerprints.text(F.col("hi"), F.col("lo")).alias("f"))
    got = {r["doc_id"]: r["f"] for r in prints.collect()}
    assert {d: plain_simhash(t) for d, t, *_ in rows} == {d: f for d, f in got.items() if d not in (23, 25, 26)}


def test_block_tables_find_all_within_the_radius(spark):
    r = random.Random(3)
    prints = set()
    for _ in range(5):
        base = r.getrandbits(128)
        prints |= {base ^ sum(1 << b for b in r.sample(range(128), r.randrange(6))) for _ in range(60)}
    signed = lambda x: x - 2**64 if x >> 63 else x
    rows = [(signed(p >> 64), signed(p % 2**64), i % 3 + 1) for i, p in enumerate(sorted(prints))]
    df = spark.createDataFrame(rows, "hi bigint, lo bigint, n bigint")
    got = {(x["hi"], x["lo"]): x["n"] for x in fingerprints.find_within(df.select("hi", "lo"), df, members=16).collect()}
    for hi, lo, _ in rows:
        want = sum(n for h, v, n in rows if ((h ^ hi) % 2**64).bit_count() + ((v ^ lo) % 2**64).bit_count() <= 3)
        assert got[hi, lo] == want


def test_near_copies_of_real_texts_are_found(spark):
    """Any radius is exact, and near copies of given texts, some words replaced, are within NEAR."""
    docs = common.read(spark, "/root/testdata/sf0.01", "documents").where("length(text) between 1500 and 6000").orderBy("doc_id").limit(60)
    texts = {r["doc_id"]: r["text"].split(" ") for r in docs.collect()}
    r, rows = random.Random(8), []
    for d, words in texts.items():
        edited = list(words)
        for at in r.sample(range(len(words)), max(1, len(words) // 50)):  # about 5 in 50 shingles change
            edited[at] = r.choice(words)
        rows += [(d, " ".join(words)), (-d - 1, " ".join(edited))]
    prints = fingerprints.simhash(spark.createDataFrame(rows, "doc_id bigint, text string"), ["doc_id"], "text").cache()
    counted = prints.groupBy("hi", "lo").agg(F.count("*").alias("n")).cache()
    of = {x["doc_id"]: (x["hi"], x["lo"]) for x in prints.collect()}
    known = [(x["hi"], x["lo"], x["n"]) for x in counted.collect()]
    bits = lambda a, b: sum(((x ^ y) % 2**64).bit_count() for x, y in zip(a, b, strict=True))
    for radius in (0, 5, fingerprints.NEAR):
        got = {(x["hi"], x["lo"]): x["n"] for x in fingerprints.find_within(counted.select("hi", "lo"), counted, radius).collect()}
        assert got == {(h, v): sum(n for a, b, n in known if bits((h, v), (a, b)) <= radius) for h, v, _ in known}
    apart = [bits(of[d], of[-d - 1]) for d in texts]
    assert sum(x <= fingerprints.NEAR for x in apart) >= 0.95 * len(apart) > 2 * sum(x <= fingerprints.RADIUS for x in apart)


def test_found_fingerprints_come_with_their_distance(spark):
    """A planted near copy is told from others by its fingerprint; counts follow from the pairs."""
    flip = lambda hi, lo, bits: (hi ^ sum(1 << b for b in bits if b < 62), lo ^ sum(1 << (b - 64) for b in bits if b >= 64))
    own = (0x1234567890ABCDEF, 0x0FEDCBA987654321)
    planted = {0: own, 2: flip(*own, [3, 70]), 11: flip(*own, range(0, 22, 2)), 18: flip(*own, range(64, 118, 3)), 19: flip(*own, range(0, 57, 3))}
    rows = [(*f, i + 1) for i, f in enumerate(planted.values())]
    df = spark.createDataFrame(rows, "hi bigint, lo bigint, n bigint")
    (got,) = fingerprints.find_within(df.limit(1), df, 18).collect()
    assert [(x["distance"], (x["hi"], x["lo"])) for x in got["found"]] == [(d, planted[d]) for d in (0, 2, 11, 18)]
    assert got["n"] == 1 + 2 + 3 + 4
    (fewer,) = fingerprints.find_within(df.limit(1), df, 18).select(fingerprints.documents(F.col("found"), 3).alias("n")).collect()
    assert fewer["n"] == 1 + 2


def test_probes_are_not_broadcast(spark):
    """1,000 queries are 24 kB, but half a million probes: these don't fit a broadcast of 16 MB."""
    rng = np.random.default_rng(15)
    prints = np.unique(rng.integers(-(2**63), 2**63, (3000, 2)), axis=0)
    prints[1500:] = prints[:1500] ^ (np.uint64(1) << rng.integers(0, 64, (1500, 2), dtype=np.uint64)).view(np.int64)  # near copies, 2 bits off
    rows = [(int(hi), int(lo), i % 3 + 1) for i, (hi, lo) in enumerate(prints)]
    df = spark.createDataFrame(rows, "hi bigint, lo bigint, n bigint").localCheckpoint()
    asked = spark.createDataFrame([r[:2] for r in rows[1000:2000]], "hi bigint, lo bigint").distinct()
    spark.conf.set("spark.sql.maxBroadcastTableSize", "16m")
    try:
        got = {(x["hi"], x["lo"]): x["n"] for x in fingerprints.find_within(asked, df, fingerprints.NEAR).collect()}
    finally:
        spark.conf.unset("spark.sql.maxBroadcastTableSize")
    n = np.array([r[2] for r in rows])
    for hi, lo, _ in rows[1000:2000]:
        differ = np.bitwise_count((prints ^ np.array([hi, lo])).view(np.uint64)).sum(axis=1)
        assert got.pop((hi, lo)) == n[differ <= fingerprints.NEAR].sum()
    assert not got


# Quality rules


def brute_measures(text):
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    seen, covered = {}, set()
    for i in range(len(w) - 7):
        seen.setdefault(tuple(w[i : i + 8]), []).append(i)
    for places in seen.values():
        if len(places) > 1:
            covered |= {p + j for p in places for j in range(8)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_rule_measures_equal_brute_force(spark, odd, odd_rows):
    more = [(100, prose(3, 12) + " " + prose(3, 12), "en", "s", 1), (101, "a b c d e f g h\n" * 5 + "x|y #1", "en", "s", 1), (102, "r " * 40, "en", "s", 1)]
    df = odd.where("doc_id is not null").unionByName(spark.createDataFrame(more, SCHEMA))
    got = sorted(tuple(r) for r in quality_rules.measures(clashing(df).select("doc_id", "text")).select("doc_id", *quality_rules.BASE).collect())
    assert got == sorted((r[0], *brute_measures(r[1])) for r in [*odd_rows, *more] if r[0] is not None)


def brute_em(patterns, n_rules, rounds, start):
    """The same fit from one start, rule by rule in plain Python: (likelihood, posteriors)."""
    pi, good, bad = start[0], [start[1]] * n_rules, [start[2]] * n_rules
    (good_prior, bad_prior, class_prior), q = (quality_rules.PRIOR_GOOD, quality_rules.PRIOR_BAD, quality_rules.PRIOR_CLASS), {}
    for _ in range(rounds + 1):
        likely = 0.0
        for v, n in patterns.items():
            a, b = pi, 1 - pi
            for r, x in enumerate(v):
                if x:
                    a *= good[r] if x > 0 else 1 - good[r]
                    b *= bad[r] if x > 0 else 1 - bad[r]
            q[v], likely = a / (a + b), likely + n * math.log(a + b)
        total = sum(patterns.values())
        pi = (sum(n * q[v] for v, n in patterns.items()) + class_prior[0]) / (total + sum(class_prior))
        rate = lambda r, w, p: (sum(n * w(v) for v, n in patterns.items() if v[r] > 0) + p[0]) / (sum(n * w(v) for v, n in patterns.items() if v[r]) + sum(p))
        good = [rate(r, lambda v: q[v], good_prior) for r in range(n_rules)]
        bad = [min(rate(r, lambda v: 1 - q[v], bad_prior), good[r]) for r in range(n_rules)]
    return likely, q


def test_expectation_maximisation_equals_plain_python(spark):
    r = random.Random(2)
    patterns = {}
    for _ in range(500):
        good = r.random() < 0.7
        v = tuple(r.choice([1, 1, 1, 0, -1]) if good else r.choice([-1, -1, 0, 1]) for _ in range(4))
        patterns[v] = patterns.get(v, 0) + 1
    df = spark.createDataFrame([(list(v), n) for v, n in patterns.items()], "votes array<int>, n bigint")
    fitted = quality_rules.fit(df, 4, rounds=10)
    each = fitted.select("model", F.explode("patterns").alias("p"))
    got = {tuple(x["v"]): x["q"] for x in each.select(F.col("p.votes").alias("v"), quality_rules.posterior(F.col("p.votes"), F.col("model"), 4).alias("q")).collect()}
    want = max((brute_em(patterns, 4, 10, start) for start in quality_rules.STARTS), key=lambda x: x[0])[1]
    assert got.keys() == want.keys() and all(abs(got[v] - want[v]) < 1e-9 for v in want)


@pytest.mark.parametrize("n", [80, 800])
def test_few_bad_documents_are_told_apart(spark, n):
    """A table of any size: those that two rules speak against are rejected, the others kept."""
    patterns = [([1] * 4, n), ([1, 1, -1, -1], n // 12), ([1, 0, 1, 1], n // 10), ([1, 1, 1, -1], n // 40)]
    fitted = quality_rules.fit(spark.createDataFrame(patterns, "votes array<int>, n bigint"), 4)
    each = fitted.select("model", F.explode("patterns").alias("p"))
    got = {tuple(x["v"]): x["q"] for x in each.select(F.col("p.votes").alias("v"), quality_rules.posterior(F.col("p.votes"), F.col("model"), 4).alias("q")).collect()}
    assert got[1, 1, -1, -1] < 0.5 and got[1, 1, 1, 1] > 0.9 and got[1, 0, 1, 1] > 0.9


def test_rule_verdicts(odd, none):
    rows = quality_rules.judge(clashing(odd)).collect()
    assert len(rows) == odd.count()
    for r in rows:
        assert r["kept"] is not None and r["base_failed"] is not None
        assert not (r["kept"] and r["base_failed"])
        if r["doc_id"] is not None and r["doc_id"] < 20:
            assert r["kept"]
    assert quality_rules.judge(none).count() == 0


# Licence scan


def test_licences_in_other_dress(spark, none):
    dressed = "Copyright (c) 2020 Someone\nAll rights reserved.\n\n" + MIT.upper().replace(",", " ;").replace("\n", "   \n")
    spelt = "MIT Licence\n\nCopyright 2021 X\n" + MIT.replace("copyright holders", "Copyright owners").replace("sublicense", "sub-license")
    rows = [(1, dressed), (2, spelt), (3, MIT + " and more"), (4, None), (5, "..."), (6, "Some text.\n released under the  MIT licence!\nMore."), (6, "twice"), (None, "Released under the MIT License.")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({"digest": F.lit(1), "license_id": F.lit(2)})
    got = license_scan.scan(df).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append((r["license_id"], r["line_licenses"]))
    assert [x[0] for x in by[1]] == ["MIT"] and [x[0] for x in by[2]] == ["MIT"]
    assert by[3] == [(None, [])] and by[4] == [(None, [])] and by[5] == [(None, [])]
    assert sorted(x[1] for x in by[6]) == [["MIT"], ["MIT"]] and by[None] == [("MIT", ["MIT"])]
    assert license_scan.scan(none).count() == 0


def test_every_known_text_is_found_whole(spark):
    """Each known text as a document of its own, dressed otherwise, and a very long text beside them."""
    known = {(i, t) for i, t in license_texts.KNOWN}
    assert {"Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "CC0-1.0", "GFDL-1.3"} <= {i for i, t in known if len(t) > 5000}
    rows = [(n, f"Copyright (c) 2019 X\n{t.upper()}\n\n  ".replace(",", " , ")) for n, (_, t) in enumerate(license_texts.KNOWN)]
    rows += [(1000, "x " * 200_000), (1001, license_texts.FILES["GPL-3"][:-40])]
    got = {r["doc_id"]: (r["license_id"], r["line_licenses"]) for r in license_scan.scan(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert [got[n][0] for n in range(len(license_texts.KNOWN))] == [i for i, _ in license_texts.KNOWN]
    assert got[1000] == (None, []) and got[1001][0] is None
    plain = spark.createDataFrame([(0, MIT.replace("COPYRIGHT HOLDERS", "copyright owners")), (1, MIT.replace("HOLDERS", "keepers"))], "doc_id bigint, text string")
    assert [r["license_id"] for r in license_scan.scan(plain).orderBy("doc_id").collect()] == ["MIT", None]


# URL filter


def test_host_path_and_explicit_rules(spark, none):
    urls = {
        "http://A.Example.COM/en/7?x#y": ("a.example.com", "/en/7", "example.com/en/7", "allow"),
        "https://x.com/en/1": ("x.com", "/en/1", "com/en/", "block"),
        "com/en/": ("", "", None, "allow"),
        "http://com/en/": ("com", "/en/", "com/en/", "block"),
        "http://notcom/en/": ("notcom", "/en/", None, "allow"),
        "http://b.example.net/de/88": ("b.example.net", "/de/88", "example.net/de/8", "block"),
        "http://b.example.net/de/7": ("b.example.net", "/de/7", "net/de/", "allow"),
        "http://z.org?u=/es/": ("z.org", "", None, "allow"),
        "a://b://c.org/es/": ("b:", "//c.org/es/", None, "allow"),
        None: ("", "", None, "allow"),
        "": ("", "", None, "allow"),
    }
    df = spark.createDataFrame([(i, u) for i, u in enumerate([*urls, *urls])], "page_id bigint, url string").withColumn("host", F.lit("x"))
    labelled = spark.createDataFrame([], "url string, bad boolean")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge(df, labelled).collect()}
    assert [got[i] for i in range(len(df.collect()))] == [*urls.values(), *urls.values()]
    assert url_filter.judge(none.select(F.col("doc_id").alias("page_id"), F.col("text").alias("url")), labelled).count() == 0


def test_mined_rules_block(spark):
    r = random.Random(4)
    rows = []
    for i in range(400):
        bad = i % 4 == 0
        host = f"{'casino-win' if bad and i % 8 else 'news'}.{r.choice(['aa', 'bb', 'cc'])}.test"
        rows.append((f"http://{host}/{r.choice(['x', 'y'])}/{i}{'?promo=1' if bad else ''}", bad if i % 3 else None))
    labelled = spark.createDataFrame(rows, "url string, bad boolean")
    rules = url_filter.mine(labelled)
    found = {tuple(x["antecedent"]) for x in rules.collect()}
    assert ("q:promo",) in found
    assert not any(len(a) > 1 and "q:promo" in a for a in found)  # pruned by the shorter rule
    pages = spark.createDataFrame([(1, "http://new.zz.test/q?promo=7"), (2, "http://new.zz.test/q")], "page_id bigint, url string")
    assert {x["page_id"]: x["verdict"] for x in url_filter.judge(pages, labelled).collect()} == {1: "block", 2: "allow"}


def test_a_rare_bad_host_is_mined(spark):
    """A host that is bad in 0.3% of the rows, and one in 5 rows, the least count, at any table size."""
    r = random.Random(9)
    rows = [(f"http://{r.choice(['aa', 'bb', 'cc'])}.test/{r.choice(['x', 'y'])}/{i}", r.random() < 0.2) for i in range(3983)]
    rows += [(f"http://spam-farm.test/x/{i}", True) for i in range(12)] + [(f"http://pills.test/y/{i}", True) for i in range(5)]
    labelled = spark.createDataFrame(rows, "url string, bad boolean")
    found = {tuple(x["antecedent"]): round(x["confidence"] * 100) for x in url_filter.mine(labelled).collect()}
    assert found[("h:spam-farm",)] == found[("h:pills",)] == 100
    pages = spark.createDataFrame([(1, "http://spam-farm.test/z"), (2, "http://pills.test/z"), (3, "http://aa.test/x")], "page_id bigint, url string")
    assert {x["page_id"]: x["verdict"] for x in url_filter.judge(pages, labelled).collect()} == {1: "block", 2: "block", 3: "allow"}


def brute_rules(rows, min_count=5, min_confidence=0.6, alpha=0.05):
    """Token sets that say bad, by going through all subsets of each row's tokens."""
    rows = [(frozenset(t), bad) for t, bad in rows]
    where = {}
    for i, (items, _) in enumerate(rows):
        for t in items:
            where.setdefault(t, set()).add(i)
    where = {t: frozenset(w) for t, w in where.items() if len(w) >= min_count}
    instead = {}
    for t, w in sorted(where.items()):
        instead.setdefault(w, t)
    merged = [(frozenset(instead[where[t]] for t in items if t in where), bad) for items, bad in rows]
    seen, bad_seen = Counter(), Counter()
    for items, bad in merged:
        for size in range(1, len(items) + 1):
            for some in itertools.combinations(sorted(items), size):
                seen[some] += 1
                bad_seen[some] += bad
    seen = {s: n for s, n in seen.items() if n >= min_count}
    base = sum(b for _, b in rows) / len(rows)
    out = {}
    for some, n in seen.items():
        c = bad_seen[some] / n
        if bad_seen[some] < min_count or c < min_confidence or c <= base:
            continue
        surprise = n * (c * math.log(c / base) + ((1 - c) * math.log((1 - c) / (1 - base)) if c < 1 else 0))
        if surprise >= math.log(len(seen) / alpha):
            out[some] = c
    return {s: c for s, c in out.items() if not any(set(t) < set(s) and d >= c for t, d in out.items())}


def test_mining_and_matching_equal_brute_force(spark):
    r, urls = random.Random(12), []
    for i in range(600):
        host = f"{r.choice(['news', 'blog', 'shop', 'casino-win'])}.{r.choice(['aa', 'bb'])}.test"
        urls.append((f"http://{host}/{r.choice(['x', 'y', 'z'])}/{r.choice(['', 'k.html'])}{'?ref=1&q=2' if r.random() < 0.3 else ''}", None))
    urls = [(u, r.random() < (0.9 if "casino" in u else 0.7 if "ref" in u and "/x/" in u else 0.15)) for u, _ in urls]
    labelled = spark.createDataFrame(urls, "url string, bad boolean")
    items = [(x["items"], x["bad"]) for x in labelled.select(url_filter.tokens(F.col("url")).alias("items"), "bad").collect()]
    want = brute_rules(items)
    rules = url_filter.mine(labelled).cache()
    got = {tuple(x["antecedent"]): x["confidence"] for x in rules.collect()}
    assert len(want) >= 2 and got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-9 for s in want)
    met = {tuple(x["items"]): x["confidence"] for x in url_filter.match(labelled, rules).collect()}
    sets = {tuple(t) for t, _ in items}
    best = {t: max((c for s, c in want.items() if set(s) <= set(t)), default=None) for t in sets}
    assert met == {t: c for t, c in best.items() if c is not None}
    index = url_filter.inverted_index(rules, spark.createDataFrame([(list(t),) for t in sets], "items array<string>")).collect()
    share = Counter(x for t in sets for x in t)
    assert all(share[x["token"]] == min(share[y] for y in x["antecedent"]) for x in index)


def test_chance_makes_no_rule(spark):
    """Labels that have nothing to do with URLs, and the given small tables."""
    for seed in range(3):
        r = random.Random(seed)
        rows = [(f"http://{r.choice('abcdefgh')}h.{r.choice('ij')}x.test/{r.choice('klm')}p/{r.choice('no')}q", r.random() < 0.3) for _ in range(500)]
        assert url_filter.mine(spark.createDataFrame(rows, "url string, bad boolean")).count() == 0
    for size in ("sf0.01", "sf0.1"):
        out = queries.op8_url_filter(spark, f"/root/testdata/{size}")
        assert out.where("confidence is not null").count() == 0


def test_tokens_that_go_together_and_odd_labels(spark):
    """Forty tokens that are always together are one; null labels, nulls and repeats are no trouble."""
    long = "/".join(f"part{c}x" for c in "abcdefghijklmnopqrstuvwxyzabcdefghijklmn")
    rows = [(f"http://bad.test/{long}", True)] * 12 + [(f"http://good.test/{c}{c}", False) for c in "abcdefgh"] * 4 + [(None, True), (None, None), ("http://bad.test/", None)]
    labelled = spark.createDataFrame(rows, "url string, bad boolean").withColumn("items", F.lit("extra"))
    assert [x["antecedent"] for x in url_filter.mine(labelled).collect()] == [["h:bad"]]
    only = spark.createDataFrame([("http://a.test", True)] * 9, "url string, bad boolean")
    assert url_filter.mine(only).count() == 0 and url_filter.mine(only.limit(0)).count() == 0


# Chat formatting


def test_chat_round_trip(spark):
    said = [r"\### Assistant: </turn> ok", "", None, "a\\h\\e\\b\\m ### : </turn>\n</turn>", "é🙂\n\n", "<" * 5 + "/turn>" * 3, "\\" * 7]
    rows = [(1, i, ["system", "user", "assistant"][i % 3], t) for i, t in enumerate(said)]
    rows += [(2, 0, "user", "q"), (2, 1, "assistant", "a"), (2, 1, "assistant", "a"), (3, None, None, "x"), (3, 0, "we: ### ird\\", "y"), (None, 0, "user", "z"), (4, 0, "system", "s"), (4, 1, "user", "u"), (4, 2, "assistant", "v")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("turns", F.lit(1)).withColumn("state", F.lit("s"))
    out = chat_format.format_chats(df).withColumns({"back": chat_format.parse_chats(F.col("formatted")), "lost": chat_format.loss_text(F.col("segments"))})
    got = {r["conv_id"]: r for r in out.collect()}
    for conv in (1, 2, 3, 4, None):
        mine = sorted(((t if t is not None else -1, r or "", x or "") for c, t, r, x in rows if c == conv))
        assert [(b["role"], b["text"]) for b in got[conv]["back"]] == [(r, x) for _, r, x in mine], conv
        assert got[conv]["lost"] == "".join(x for _, r, x in mine if r == "assistant")
    assert {c: got[c]["valid"] for c in got} == {1: False, 2: False, 3: False, 4: True, None: False}
    assert chat_format.format_chats(df.limit(0)).count() == 0


# Mixing


def waterfill(sizes, weights=(5, 2, 1), share=1.5, cap=2.0):
    """Targets by sharing again and again what capped sources leave."""
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, target = share * sum(sizes.values()), {}
    free = list(names)
    while free:
        total = sum(w[s] for s in free)
        over = [s for s in free if left * w[s] / total >= cap * sizes[s]]
        if not over:
            return target | {s: left * w[s] / total for s in free}
        for s in over:
            target[s] = cap * sizes[s]
        left -= sum(target[s] for s in over)
        free = [s for s in free if s not in over]
    return target


def test_targets_equal_repeated_sharing(spark):
    sizes = {"b": 100, "a": 5, "c": 0, "é": 900, None: 30, "Z": 400, "d": 7, "e": 7}
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size bigint")
    got = {r["source"]: r["target"] for r in mixing.source_targets(df).collect()}
    want = waterfill(sizes)
    assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-6 for s in want)


def test_mix_emits_rates(spark, odd, none):
    docs = clashing(odd)
    planned = mixing.plan_mix(docs).collect()
    assert len(planned) == odd.count()
    for r in planned:
        assert r["size"] == len(WORD.findall(r["text"] or "")) and 0 <= r["copies"] <= 2
    out = mixing.mix(docs)
    assert out.columns == docs.columns and out.count() == sum(r["copies"] for r in planned)
    again = mixing.mix(docs)
    assert out.exceptAll(again).isEmpty() and again.exceptAll(out).isEmpty()
    assert mixing.mix(none).count() == 0
    many = spark.range(20_000).selectExpr("id as doc_id", "repeat('w ', cast(id % 50 as int)) as text", "concat('s', id % 3) as source")
    for r in mixing.plan_mix(many).groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("took"), F.first("target").alias("t")).collect():
        assert abs(r["took"] - r["t"]) < 0.03 * r["t"]


def test_numpy_has_bit_counts():
    assert np.bitwise_count(np.uint64(7)) == 3
