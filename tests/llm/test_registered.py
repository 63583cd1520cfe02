"""The registered queries as they are called: columns, types and rules of each contract."""

import hashlib
import zlib

import pytest
from test_text_operators import brute_measures, fingerprint, plain_simhash

from factlake.llm import fingerprints, queries

SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Tables of the driver's kind, with nulls, blank texts, copies and a repeated label."""
    path = tmp_path_factory.mktemp("tables")
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").where("length(text) < 6000")
    odd = [(10_001, None, None, None, None), (10_002, "", "en", "a", 0), (10_003, " \n\t", "en", None, 3), (10_004, "one", "en", "a", 3), (10_020, "x y\n" * 9, "en", "a", 36)]
    docs.unionByName(spark.createDataFrame(odd, DOCS).select(*docs.columns)).write.parquet(f"{path}/documents.parquet")
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    more = spark.createDataFrame([(10_001, None, 0), (10_001, 1, None), (None, 0, 1)], "doc_id bigint, quality int, toxic int")
    labels.select("doc_id", "quality", "toxic").unionByName(more).write.parquet(f"{path}/labels.parquet")
    for table in ("pages", "conversations"):
        spark.read.parquet(f"{SMALL}/{table}.parquet").write.parquet(f"{path}/{table}.parquet")
    return str(path)


@pytest.fixture(scope="module")
def texts(spark, folder):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}


def run(spark, folder, name):
    out = queries.QUERIES[name](spark, folder)
    return dict(out.dtypes), out.collect()


@pytest.mark.parametrize(("name", "parts", "held", "least"), [("op2_quality_crf", 3, 1, 0.5), ("op7_toxicity", 4, 2, 0.3)])
def test_scores(spark, folder, texts, name, parts, held, least):
    types, rows = run(spark, folder, name)
    assert types == {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"}
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % parts == held)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= least)
    by = {}
    for r in rows:
        assert by.setdefault(texts[r["doc_id"]] or "", r["score"]) == pytest.approx(r["score"], abs=1e-5)  # equal texts


def test_fingerprints(spark, folder, texts):
    types, rows = run(spark, folder, "op3_fingerprints")
    want = {"doc_id": "bigint", "n_chars": "bigint", "edited_sha256": "string", "fingerprint": "string", "edited_fingerprint": "string", "near_edited": "double", "near_next": "double"}
    assert want.items() <= types.items()
    order, got = sorted(texts, reverse=True), {r["doc_id"]: r for r in rows}
    prints = {d: plain_simhash(t) for d, t in texts.items()}
    like = lambda a, b: 1 - (int(a, 16) ^ int(b, 16)).bit_count() / 128
    assert len(rows) == len(texts)
    for i, d in enumerate(order):
        text, after = texts[d] or "", order[(i + 1) % len(order)]
        took, r = len(text) // 3, got[d]
        edited = text[: len(text) - took] + (texts[after] or "")[:took]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert r["fingerprint"] == prints[d] and r["edited_fingerprint"] == plain_simhash(edited)
        assert r["near_edited"] == pytest.approx(like(prints[d], plain_simhash(edited))) and r["near_next"] == pytest.approx(like(prints[d], prints[after]))
        if d % 20:
            assert r["near"] is None and r["n_within_3"] is None
        else:
            apart = {f: (int(prints[d], 16) ^ int(f, 16)).bit_count() for f in prints.values()}
            assert {(x["fingerprint"], x["distance"]) for x in r["near"]} == {(f, n) for f, n in apart.items() if n <= fingerprints.NEAR}
            assert r["n_within_3"] == sum(apart[f] <= 3 for f in prints.values())


def test_near_duplicates(spark, folder, texts):
    types, rows = run(spark, folder, "op4_simhash_dedup")
    assert types == {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"}
    prints = {d: fingerprint(t) for d, t in texts.items()}
    assert {r["doc_id"]: r["fingerprint"] for r in rows} == {d: f"{p:016x}" for d, p in prints.items()}
    least = {}
    for d in sorted(texts):  # smallest document reachable, by flooding from the smallest
        todo = [d] if d not in least else []
        while todo:
            x = todo.pop()
            least[x] = d
            todo += [y for y in texts if y not in least and y not in todo and (prints[x] ^ prints[y]).bit_count() <= 3]
    assert {r["doc_id"]: r["component_id"] for r in rows} == least


def test_tokens(spark, folder, texts):
    tokenizers = pytest.importorskip("tokenizers")
    public = pytest.importorskip("public_tokenizers")
    library = tokenizers.Tokenizer.from_file(public.path("word_bpe_49k.json"))
    library.no_truncation()
    library.no_padding()
    types, rows = run(spark, folder, "op5_bpe")
    assert types == {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    for r in rows:
        ids = library.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        assert tuple(r) == (r["doc_id"], len(ids), sha(" ".join(map(str, ids))), sha(decoded))


def test_rules(spark, folder, texts):
    types, rows = run(spark, folder, "op6_quality_rules")
    counts = {n: "bigint" for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")}
    assert ({"doc_id": "bigint", "base_failed": "boolean", "kept": "boolean"} | counts).items() <= types.items()
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    for r in rows:
        assert tuple(r[n] for n in counts) == brute_measures(texts[r["doc_id"]])
        assert r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"])
        assert r["kept"] is (not r["base_failed"] and r["quality"] >= 0.5)


@pytest.mark.parametrize("size", ["sf0.01", "sf0.1"])
def test_rules_reject_what_is_labelled_low_at_every_size(spark, size):
    rows = queries.op6_quality_rules(spark, f"/root/testdata/{size}").where("not base_failed").drop("quality")
    labels = spark.read.parquet(f"/root/testdata/{size}/labels.parquet")
    share = {r["quality"]: r["share"] for r in rows.join(labels, "doc_id").groupBy("quality").agg({"kept": "count"}).withColumnRenamed("count(kept)", "share").collect()}
    kept = {r["quality"]: r["count"] for r in rows.where("kept").join(labels, "doc_id").groupBy("quality").count().collect()}
    assert kept.get(0, 0) <= 0.1 * share[0] and kept[1] >= 0.99 * share[1]


def test_urls(spark, folder):
    types, rows = run(spark, folder, "op8_url_filter")
    assert {"page_id": "bigint", "host": "string", "path": "string", "rule": "string", "verdict": "string"}.items() <= types.items()
    urls = {r["page_id"]: r["url"] for r in spark.read.parquet(f"{folder}/pages.parquet").collect()}
    fixed = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]
    assert sorted(r["page_id"] for r in rows) == sorted(urls)
    for r in rows:
        rest = (urls[r["page_id"]] or "").partition("://")[2]
        host = rest[: min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))]
        path = rest[len(host) :]
        path = path[: min((path.find(c) for c in "?#" if c in path), default=len(path))]
        met = [(len(t), k, t) for k, t in fixed if f".{host.lower()}".endswith("." + t.partition("/")[0]) and path.startswith("/" + t.partition("/")[2])]
        assert (r["host"], r["path"], r["rule"]) == (host.lower(), path, max(met)[2] if met else None)
        assert r["verdict"] == max(met)[1] if met else r["verdict"] in ("allow", "block")
