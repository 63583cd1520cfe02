"""Search, planner, staging, governance, blocks, codecs and services."""

import json
import re
import threading
from urllib.error import HTTPError
from urllib.request import Request, urlopen

import numpy as np
import pytest
from pyspark.sql import functions as F

from factlake.errors import Corrupt, Denied
from factlake.functions import codecs, embed, hashing
from factlake.functions.distance import l2_sq
from factlake.operators import ann, blocks, disclosure, governance, graph, knn, near
from factlake.plans import indexes, planner
from factlake.plans.engine import Config, Engine, Governed
from factlake.plans.store import Store
from factlake.service import api
from factlake.sources import views

DIM = 16


def vectors(spark, n=1000, seed=1, dim=DIM):
    r = np.random.default_rng(seed)
    data = r.random((n, dim)).astype(np.float32)
    category = [0 if i % 100 < 50 else 1 if i % 100 < 80 else 2 if i % 100 < 95 else 3 if i % 100 < 99 else 4 for i in range(n)]
    rows = [(i, 0, category[i], data[i].tolist(), i + 1, 1.0, 1 + 4 * dim) for i in range(n)]
    df = spark.createDataFrame(rows, "sid bigint, pred bigint, category int, embedding array<float>, seq bigint, c float, val_bytes bigint")
    return df, data, np.array(category)


def brute(data, query, k, keep=None):
    d = ((data.astype(np.float64) - np.asarray(query, dtype=np.float64)) ** 2).sum(1)
    ids = [i for i in np.lexsort((np.arange(len(d)), d)) if keep is None or keep[i]]
    return [int(i) for i in ids[:k]]


def sids(df):
    return [r["sid"] for r in df.collect()]


def test_exact_search_equals_brute_force(spark):
    df, data, category = vectors(spark)
    q = data[17].tolist()
    assert sids(knn.nearest(df, q, 8)) == brute(data, q, 8)
    assert sids(knn.nearest_by_shard(df, q, 8, 8)) == brute(data, q, 8)
    assert sids(near.near_select(df, q, 8, F.col("category") == 3)) == brute(data, q, 8, category == 3)
    assert sids(knn.nearest(df, q, 0)) == [] and sids(knn.nearest(df, q[:-1], 5)) == []
    plan = knn.nearest(df, q, 8)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


def test_many_queries_at_once(spark):
    df, data, _ = vectors(spark)
    df = df.unionByName(df.where("sid < 5").withColumn("sid", F.col("sid") + 5000))  # ties
    queries = df.where("sid % 50 = 0").select(F.col("sid").alias("query_id"), F.col("embedding").alias("vector"))
    got = {}
    for r in knn.nearest_batch(df, queries, 6).orderBy("place").collect():
        got.setdefault(r["query_id"], []).append(r["sid"])
    both = np.concatenate([data, data[:5]])
    names = [*range(1000), *range(5000, 5005)]
    for q in got:
        d = ((both.astype(np.float64) - both[names.index(q)].astype(np.float64)) ** 2).sum(1)
        assert got[q] == [names[i] for i in np.lexsort((names, d))[:6]]


def test_planner_constants():
    assert [planner.plan(s, 10, 0.9).over_fetch for s in (0.5, 0.3, 0.15, 0.04, 0.01)] == [9, 15, 30, 113, 450]
    assert planner.plan(0.02, 8, 0.9).over_fetch == 225 and planner.plan(0.0, 8, 0.99).over_fetch == 4096
    assert planner.plan(1.0, 8, 0.5) == planner.Plan(2, 64, 1.0, 16)


@pytest.mark.parametrize(("category", "target"), [(0, 0.9), (4, 0.9)])
def test_postfilter_reaches_the_planned_recall(spark, category, target):
    df, data, cats = vectors(spark, 2000)
    plan = planner.plan(float((cats == category).mean()), 8, target)
    hits = 0
    for i in range(5):
        q = data[i * 7].tolist()
        got = sids(near.near_select_postfilter(df, df, q, 8, plan.over_fetch, F.col("category") == category))
        assert all(cats[s] == category for s in got)
        hits += len(set(got) & set(brute(data, q, 8, cats == category)))
    assert hits / 40 >= 0.85


def test_inverted_file_and_hashing_recall(spark):
    df, data, _ = vectors(spark, 1500, dim=8)
    rows, centres = ann.build_ivf(df, 12)
    rows, centres = rows.cache(), centres.cache()
    one = two = 0
    for i in range(6):
        q = data[i * 11].tolist()
        want = set(brute(data, q, 10))
        one += len(want & set(sids(ann.ivf(rows, centres, q, 10, 8))))
        two += len(want & set(sids(ann.lsh(df, q, 10))))
    assert one / 60 >= 0.9 and two / 60 >= 0.9
    asked = df.where("sid in (0, 11, 22, 33, 44, 55)").select(F.col("sid").alias("query_id"), F.col("embedding").alias("vector"))
    got = knn.recall(knn.nearest_batch(df, asked, 10), ann.ivf_batch(rows, centres, asked, 10, 8), 10)
    assert round(10 * got.agg(F.sum("recall")).first()[0]) == one


def test_staged_results(spark):
    df, data, _ = vectors(spark)
    rows = disclosure.ranked(knn.nearest(df, data[0].tolist(), 40))
    s = disclosure.summary(rows, 5).first()
    d = sorted(((data.astype(np.float64) - data[0].astype(np.float64)) ** 2).sum(1))[:40]
    assert (s["n"], s["stage0_tokens"] < s["full_tokens"]) == (40, True)
    assert np.allclose([s["dist_min"], s["dist_median"], s["dist_max"]], [d[0], d[20], d[39]])
    assert abs(s["sharpness"] - (d[1] - d[0]) / (d[39] - d[0])) < 1e-9
    assert [r["rank"] for r in disclosure.representatives(rows, 5).orderBy("rank").collect()] == [0, 8, 16, 24, 32]
    six = disclosure.ranked(knn.nearest(df, data[0].tolist(), 6))
    assert [r["rank"] for r in disclosure.representatives(six, 5).orderBy("rank").collect()] == [0, 2, 4]
    empty = disclosure.summary(rows.limit(0), 5).first()
    assert (empty["n"], empty["dist_max"], empty["sharpness"], empty["stage0_tokens"]) == (0, 0.0, 1.0, 16)


def test_rules_and_their_precedence(spark):
    rules = [(0, 1, "read", "allow", "any", None), (1, 1, "read", "mask", "category", 1), (2, 1, "read", "deny", "pred", 7), (3, 1, "write", "mask", "any", None)]
    rows = [(1, "read", 0, 0, "allow"), (1, "read", 1, 0, "mask"), (1, "read", 1, 7, "deny"), (1, "read", None, 0, "allow"), (1, "write", 0, 0, "deny"), (2, "read", 0, 0, "deny")]
    df = spark.createDataFrame(rows, "agent bigint, action string, category int, pred bigint, want string")
    table = spark.createDataFrame(rules, "rule_id bigint, agent bigint, action string, effect string, match_kind string, match_value bigint")
    assert all(r["decision"] == r["want"] for r in governance.decide(df, table).collect())
    for agent, action, *_ in rows:
        mine = df.where((F.col("agent") == agent) & (F.col("action") == action))
        assert all(r["d"] == r["want"] for r in mine.withColumn("d", governance.decision(rules, agent, action)).collect())


def test_budgets_fold_in_order(spark):
    rows = {(r["agent"], r["seq"]): (r["allowed"], r["remaining"]) for r in governance.budget_ledger(views.query_log(spark), 200).collect()}
    assert rows == {(1, 0): (True, 40), (1, 1): (False, 40), (1, 2): (True, 10), (2, 0): (True, 128), (2, 1): (False, 128), (2, 2): (True, 72), (3, 0): (False, 200)}


def test_blocks_are_exact_and_skip(spark):
    grains = views.grains_clustered(spark, 3000, 30, 8)
    rows = blocks.assign_kmeans(grains, 24).cache()
    assert rows.count() == 3000 and rows.where("block_id is null").count() == 0
    described = blocks.descriptors(rows).cache()
    assert described.agg(F.sum("n")).first()[0] == 3000
    table = grains.orderBy("sid").collect()
    data = np.array([r["embedding"] for r in table])
    skipped = 0
    for i in (0, 700, 1500):
        q = data[i].tolist()
        found, stats = blocks.near(rows, described, q, 10)
        assert sids(found) == brute(data, q, 10)
        skipped += stats.total - stats.touched
    assert skipped > 0
    filters = blocks.blooms(rows).cache()
    own = {r["sid"]: r["block_id"] for r in rows.select("sid", "block_id").collect()}
    asked = list(range(0, 3000, 97))
    maybe = {tuple(r) for r in blocks.may_hold(filters, asked).collect()}
    assert all((sid, own[sid]) in maybe for sid in asked)  # no false negatives
    assert len(maybe) < 5 * len(asked)
    found, stats = blocks.get(rows, filters, 42)
    assert sids(found) == [42] and stats.touched < stats.total
    count = blocks.count_category(blocks.category_counts(rows), 2).first()
    assert count["n"] == rows.where("category = 2").count()
    assert blocks.near(rows, described, data[0].tolist(), 0)[0].count() == 0
    assert blocks.assign_kmeans(grains.limit(0), 4).count() == 0


def test_embedding_equals_the_scalar_definition(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("length(text) < 400").select("text")
    texts = [r["text"] for r in docs.limit(40).collect()] + ["a", "é🙂"]
    for text in texts:
        data, want = text.encode(), np.zeros(DIM)
        for width in (1, 2, 3):
            for i in range(len(data) - width + 1):
                h = hashing.fnv1a_bytes(data[i : i + width])
                want[h % DIM] += -1.0 if h >> 63 else 1.0
        want /= max(np.sqrt((want**2).sum()), 1e-6)
        assert np.allclose(embed.embed(text, DIM), want, atol=1e-6)
    df = spark.createDataFrame([("a b",), ("",), (None,)], "text string")
    assert [r[0] is None for r in df.select(embed.embed_text(F.col("text"), DIM)).collect()] == [False, True, True]


def test_hashes(spark):
    df = spark.createDataFrame([("",), ("a",), ("foobar",), ("é",), (None,)], "s string")
    got = [r[0] for r in df.select(hashing.fnv1a(F.col("s"))).collect()]
    assert got == [f"{hashing.fnv1a_bytes(s.encode()):016x}" for s in ("", "a", "foobar", "é")] + [None]
    assert df.select(hashing.crc32(F.lit("123456789"))).first()[0] == 0xCBF43926
    for n in (1, 10, 1000):
        bits, size = hashing.bloom_size(n)
        row = spark.range(1).select(*hashing.bloom_params(F.lit(n))).first()
        assert tuple(row) == (bits, size)
        members = np.arange(n) * 7 + 3
        bloom = hashing.bloom_build(members, bits, size)
        assert hashing.bloom_contains(bloom, members, bits, size).all()
    def route(x):
        x ^= x >> 33
        x = x * 0xFF51AFD7ED558CCD % 2**64
        return (x ^ (x >> 33)) % 8

    many = [0, 1, 12345, 2**40 + 7, 2**62]
    routed = spark.createDataFrame([(x,) for x in many], "sid bigint").select(hashing.shard_of(F.col("sid"), 8)).collect()
    assert [r[0] for r in routed] == [route(x) for x in many]
    assert hashing.bloom_contains(bloom, np.arange(10**6, 10**6 + 5000), bits, size).mean() < 0.03


def test_codecs(spark):
    df = spark.createDataFrame([(7, -5, "é"), (255, 2**62, "")], "category int, amount bigint, text string")
    back = df.select(codecs.decode_store_value(codecs.encode_store_value(F.col("category"), F.col("amount"), F.col("text"))).alias("v")).select("v.*")
    assert [tuple(r) for r in back.collect()] == [(7, -5, "é"), (255, 2**62, "")]
    short = spark.createDataFrame([(b"\x01",), (b"",)], "v binary")
    assert [tuple(r[0]) for r in short.select(codecs.decode_store_value(F.col("v"))).collect()] == [(0, 0, "")] * 2
    assert [r[0] for r in short.select(codecs.header_byte(F.col("v"), 0)).collect()] == [1, None]
    keys = spark.createDataFrame([(1, 0, 5), (1, 0, 9), (1, 1, 1), (2, 0, 1)], "sid bigint, pred bigint, seq bigint")
    keyed = keys.withColumn("k", codecs.grain_key(F.col("sid"), F.col("pred"), F.col("seq")))
    assert [r["seq"] for r in keyed.orderBy("k").collect()] == [9, 5, 1, 1]
    assert all(r["seq"] == r["s"] for r in keyed.withColumn("s", codecs.seq_of_key(F.col("k"))).collect())
    pair = spark.createDataFrame([([1.0, 2.0], [4.0, 6.0])], "a array<float>, b array<float>")
    assert pair.select(l2_sq(F.col("a"), F.col("b"))).first()[0] == 25.0


def facts(df):
    return df.select(F.col("sid").alias("arrival"), "sid", "pred", "category", "embedding", F.col("sid").alias("idem_key"))


def test_engine_and_governed_engine(spark, tmp_path):
    df, data, cats = vectors(spark, 60)
    engine = Engine(spark, str(tmp_path / "e"), DIM)
    engine.put_vectors(facts(df))
    q = data[3].tolist()
    rows, plan = engine.query_planned(0, q, 5, 0.9, category=1)
    assert sids(rows) == brute(data, q, 5, cats == 1) and plan.over_fetch >= 9
    summary, shown, handle = engine.query_staged(0, q, 10, 0.9, 3)
    before = sids(engine.drill(handle).orderBy("rank"))
    gone = df.where("sid < 30").select((F.col("sid") + 1000).alias("arrival"), "sid", "pred", (F.col("sid") + 1000).alias("idem_key"))
    engine.delete(gone)
    assert engine.index_len() == 30 and sids(engine.drill(handle).orderBy("rank")) == before == brute(data, q, 10)
    assert engine.drill(99) is None and summary.first()["n"] == 10 and shown.count() == 3
    assert engine.get(2, 0).count() == 0 and engine.get(2, 0, snapshot=60).count() == 1
    rules = [(0, 1, "read", "allow", "any", None), (1, 1, "write", "allow", "any", None), (2, 1, "write", "deny", "category", 1), (3, 2, "read", "mask", "any", None)]
    governed = Governed(engine, rules, 200)
    more = facts(df.where("sid >= 50").withColumn("sid", F.col("sid") + 500))
    assert governed.put_vectors(1, more) == int((cats[50:] == 1).sum())
    assert governed.get(2, 40, 0)["masked"] and governed.get(3, 40, 0) is None and governed.get(1, 12345, 0) is None
    cost = 2 * ((1 + 4 * DIM) // 4 + 8)
    assert len(governed.query_planned(1, 0, q, 2, 0.9)) == 2 and governed.remaining[1] == 200 - cost
    assert governed.query_planned(1, 0, q, 20, 0.9) is None and governed.remaining[1] == 200 - cost
    last = governed.trail().orderBy(F.col("seq").desc()).first()
    assert last["decision"] == "deny" and last["tokens"] == 10 * cost and last["seq"] == governed.trail().count() - 1
    again = Governed(engine, rules, 200, governed.path)  # after a restart
    assert again.remaining == governed.remaining and again.trail().count() == governed.trail().count()
    with pytest.raises(Denied):
        governed.must_put(1, more.withColumn("category", F.lit(1)))
    assert governed.query_staged(1, 0, q, 20, 0.9, 3) is None
    mine, _, own = governed.query_staged(1, 0, q, 1, 0.9, 3)
    assert mine.first()["n"] == 1 and sids(engine.drill(own)) == sids(engine.query(0, q, 1))
    rows = spark.createDataFrame([(1, 40, 0, 9001), (2, 41, 0, 9002)], "arrival bigint, sid bigint, pred bigint, idem_key bigint")
    assert governed.delete(1, rows) == 2 and engine.get(40, 0).count() == 1
    governed.rules.append((4, 1, "delete", "allow", "category", int(cats[40])))
    assert governed.delete(1, rows.where("sid = 40")) == 0 and engine.get(40, 0).count() == 0
    small = disclosure.Continuations(spark, capacity=1)
    first = small.pin(shown)
    second = small.pin(shown)
    assert small.drill(first) is None and small.drill(second).count() == 3


def test_store_and_services(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    server = api.serve(store, 0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"

    def call(path, body=None):
        with urlopen(Request(base + path, data=body.encode() if body is not None else None)) as got:
            return json.loads(got.read())

    assert call("/health") == {"status": "ok", "indexed": 0} and call("/stats?x=1") == {"indexed": 0, "dim": store.dim}
    items = [{"sid": i, "text": t, "category": i % 2, "amount": i * 10} for i, t in enumerate(["red apple pie", "green apple tart", "steel bridge", ""])]
    assert call("/grains", json.dumps(items)) == {"loaded": 4, "new": 4, "indexed": 3}
    assert call("/grains", json.dumps(items)) == {"loaded": 4, "new": 0, "indexed": 3}
    found = call("/query", json.dumps({"text": "apple pie", "k": 2}))["matches"]
    assert found[0]["sid"] == 0 and len(found) == 2
    assert [m["sid"] for m in call("/query", json.dumps({"text": "apple", "category": 1, "min_amount": 5}))["matches"]] == [1]
    for path, body, status in (("/query", "{}", 400), ("/query", "", 400), ("/grains", "[{}]", 400), ("/grains", "[]", 400), ("/grains", "", 400), ("/nothing", None, 404)):
        with pytest.raises(HTTPError) as error:
            call(path, body)
        assert error.value.code == status
    assert api.main(["--server", base, "stats"]) == 0 and api.main(["--server", base, "query", "apple", "-k", "1"]) == 0
    server.shutdown()
    server.server_close()
    listed = api.rpc(store, '{"jsonrpc": "2.0", "id": 1, "method": "tools/list"}')
    assert {t["name"] for t in listed["result"]["tools"]} == set(api.TOOLS)
    assert all(t["inputSchema"]["type"] == "object" for t in listed["result"]["tools"]) and listed["result"]["tools"][0]["inputSchema"]["required"] == ["grains"]
    for arguments in ({}, {"grains": [{"sid": 1}]}):
        bad = api.rpc(store, json.dumps({"id": 9, "method": "tools/call", "params": {"name": "grain_load", "arguments": arguments}}))
        assert bad["result"]["isError"]
    asked = {"jsonrpc": "2.0", "id": 2, "method": "tools/call", "params": {"name": "grain_query", "arguments": {"text": "bridge", "k": 1}}}
    assert json.loads(api.rpc(store, json.dumps(asked))["result"]["content"][0]["text"])["matches"][0]["sid"] == 2
    assert api.rpc(store, '{"method": "initialized"}') is None and "error" in api.rpc(store, '{"id": 3, "method": "x"}')
    assert store.load(spark.createDataFrame([(0, 0, 0, "blue sky")], "sid bigint, category int, amount bigint, text string"), upsert=True).new == 1
    assert store.query("blue sky", 1).first()["text"] == "blue sky"


@pytest.mark.parametrize("kind", ["exact", "blocks", "inverted", "graph"])
def test_engines_with_an_index(spark, tmp_path, kind):
    """The default engine, and ones with an index: recall as planned, deletes and updates seen after a sync."""
    df, data, cats = vectors(spark, 400, dim=12)
    path = str(tmp_path / "index")
    index = {"exact": indexes.Exact, "blocks": indexes.Blocks, "inverted": indexes.Inverted, "graph": indexes.Graph}[kind](spark, path=path)
    if kind in ("blocks", "inverted"):
        index.cells = 8
    if kind == "graph":
        index.shard_rows = 150
    engine = Engine.open_with(spark, str(tmp_path / "e"), Config(12), index)
    engine.put_vectors(facts(df))
    assert engine.sync(400, 60) and engine.index_len() == index.size() == 400 and not engine.sync(401, 0.1)
    hits = total = 0
    for i in (3, 90, 200, 333):
        q, category = data[i].tolist(), int(cats[i])
        rows, _ = engine.query_planned(0, q, 8, 0.95, category)
        want = brute(data, q, 8, cats == category)
        hits, total = hits + len(set(sids(rows)) & set(want)), total + 8
    assert hits / total >= {"exact": 1.0, "blocks": 1.0, "inverted": 0.9, "graph": 0.9}[kind]
    q = data[3].tolist()
    engine.delete(spark.createDataFrame([(9001, 3, 0, 9001)], "arrival bigint, sid bigint, pred bigint, idem_key bigint"))
    assert 3 not in sids(engine.query(0, q, 5, over_fetch=4))  # the facts say so, whatever the index has
    assert engine.rebuild() == 399 and sids(engine.query(0, q, 5, over_fetch=40, ef=256)) == brute(data, q, 6)[1:]
    assert engine.is_healthy()


def test_raw_values_and_an_embedder(spark, tmp_path):
    engine = Engine.open_with(spark, str(tmp_path / "e"), Config(2, header=1))
    values = [b"\x07" + np.array(v, "<f4").tobytes() for v in ([0.0, 1.0], [3.0, 4.0])] + [b"short"]
    rows = spark.createDataFrame([(i, i, 0, v, i) for i, v in enumerate(values)], "arrival bigint, sid bigint, pred bigint, value binary, idem_key bigint")
    engine.put_raw(rows)
    assert engine.index_len() == 2 and sids(engine.query(0, [3.0, 4.0], 5)) == [1, 0] and engine.current().count() == 3
    assert engine.query_planned(0, [0.0, 0.0], 1, 0.9, category=7)[1].est_selectivity == 1e-4  # raw facts count in no category
    length = Engine.open_with(spark, str(tmp_path / "f"), Config(1), embedder=lambda value: F.array(F.octet_length(value).cast("float")))
    length.put_raw(rows)
    assert sids(length.query(0, [5.0], 3)) == [2, 0, 1]


def test_blocks_on_disk_are_pruned(spark, tmp_path):
    grains = views.grains_clustered(spark, 2000, 20, 8)
    rows = blocks.assign_kmeans(grains, 16)
    blocks.write(rows, str(tmp_path / "b"))
    stored = blocks.Stored(spark, str(tmp_path / "b"))
    data = np.array([r["embedding"] for r in grains.orderBy("sid").collect()])
    for i in (0, 900):
        found, stats = stored.near(data[i].tolist(), 10)
        assert sids(found) == brute(data, data[i].tolist(), 10) and stats.touched < stats.total
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert re.search(r"PartitionFilters: \[[^]]*block_id", plan)
    found, stats = stored.get(42)
    assert sids(found) == [42] and stats.touched < stats.total
    assert stored.count_category(2).first()["n"] == 500 and stored.rows().count() == 2000
    blocks.write(rows.limit(0), str(tmp_path / "none"))
    assert blocks.Stored(spark, str(tmp_path / "none")).rows().count() == 0


def test_graphs_of_shards(spark):
    r = np.random.default_rng(3)
    data = r.normal(size=(2000, 32))
    one = graph.Graph.load(graph.Graph(np.arange(2000), data).dump())
    hits = 0
    for q in r.normal(size=(40, 32)):
        want = np.argsort(((data - q) ** 2).sum(1))[:10]
        found = one.search(q, 10, 64)
        assert [d for _, d in found] == sorted(d for _, d in found)
        hits += len({s for s, _ in found} & set(want.tolist()))
    assert hits / 400 >= 0.9
    assert all((x >= 0).sum(1).max() <= (16 if i else 32) for i, (_, x) in enumerate(one.layers))
    assert graph.Graph(np.array([5]), data[:1]).search(data[0], 3, 8)[0][0] == 5
    assert graph.Graph(np.empty(0, np.int64), data[:0]).search(data[0], 3, 8) == []
    levels = graph.drawn_levels(20_000)
    assert abs((levels >= 1).mean() - 1 / 16) < 0.01 and levels.tolist() == graph.drawn_levels(20_000).tolist()


def test_nearest_rank_percentile(spark):
    df = spark.createDataFrame([(float(x),) for x in (5, 1, 1, 9, 3, 7, 7)] + [(None,)], "x double")
    ordered = [1, 1, 3, 5, 7, 7, 9]
    for p in (0, 8, 25, 50, 75, 90, 99, 100):
        assert knn.percentile(df, "x", p).first()["value"] == ordered[int(p / 100 * 6 + 0.5)]
    assert knn.percentile(df.limit(0), "x", 50).first()["value"] == 0


def test_stored_values(spark):
    df = spark.createDataFrame([(0, 0.25, -5, b"abc"), (1, 1.0, 2**40, None)], "op int, c float, t_valid bigint, val binary")
    packed = df.select(codecs.encode_value(F.col("op"), F.col("c"), F.col("t_valid"), F.col("val")).alias("v")).collect()
    assert codecs.value_parts(bytes(packed[1]["v"])) == (1, 1.0, 2**40, b"")
    back = spark.createDataFrame(packed, "v binary").select(codecs.decode_value(F.col("v")).alias("x")).select("x.*").collect()
    assert [tuple(r) for r in back] == [(0, 0.25, -5, bytearray(b"abc")), (1, 1.0, 2**40, bytearray())]
    with pytest.raises(Corrupt):
        codecs.value_parts(b"short")
    with pytest.raises(Exception, match="corrupt value: 5 bytes"):
        spark.createDataFrame([(b"short",)], "v binary").select(codecs.decode_value(F.col("v"))).collect()


def test_more_queries_than_go_at_once(spark, monkeypatch):
    """Query sets beyond the bound, at it and empty give what one block gives."""
    df, _, _ = vectors(spark, 300, dim=8)
    rows, centres = ann.build_ivf(df, 6)
    rows, centres = rows.cache(), centres.cache()
    some = df.where("sid < 20").select(F.col("sid").alias("query_id"), F.col("embedding").alias("vector"))
    found = lambda of: [sorted(map(tuple, x.collect())) for x in (knn.nearest_batch(df, of, 4), ann.ivf_batch(rows, centres, of, 4, 3))]
    want = found(some)
    assert len(want[0]) == len(want[1]) == 80
    for bound, blocks in ((7, 3), (10, 2), (20, 1)):
        monkeypatch.setattr(knn, "BROADCAST_ROWS", bound)
        assert [len(names) <= bound for names, _ in knn.query_sets(some)] == [True] * blocks
        assert found(some) == want
    assert found(some.limit(0)) == [[], []]


def test_block_statistics_of_a_query_set(spark):
    """Each query's blocks are those that the search of one query leaves; the query grows with its table."""
    from factlake import queries

    rows = blocks.assign_kmeans(views.grains_clustered(spark, 600), 12).cache()
    described = blocks.descriptors(rows).cache()
    asked = rows.where("sid % 100 = 0").select(F.col("sid").alias("query_id"), F.col("embedding").alias("vector"))
    for k in (1, 10, 1000):
        want = {r["query_id"]: (len(hit), n) for r in asked.collect() for hit, n in [blocks.surviving(described, r["vector"], k)]}
        assert {r["query_id"]: (r["touched"], r["total"]) for r in blocks.touched(described, asked, k).collect()} == want
    n = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").count()
    assert queries.block_stats(spark, "/root/testdata/sf0.01").count() == -(-n // 20)
