"""Versions, writes, recovery and the change stream against the model."""

import random
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from model import Model
from pyspark.sql import functions as F

from factlake.errors import Closed
from factlake.operators import idempotency, mvcc, sequence
from factlake.sources import frames, ingest
from factlake.sources import log as log_module
from factlake.sources.log import FactLog
from factlake.streaming import changes

ROWS = "seq bigint, sid bigint, pred bigint, op smallint, val string, idem_key bigint"
LOG = "seq bigint, sid bigint, pred bigint, op int, val string, idem_key bigint"

program = st.lists(st.tuples(st.integers(0, 7), st.integers(0, 2), st.sampled_from([0, 0, 0, 1]), st.text("abc", max_size=3), st.integers(0, 30)), min_size=1, max_size=60)


def run(ops):
    model = Model()
    for sid, pred, op, val, idem in ops:
        model.write(sid, pred, op, val if op == 0 else None, idem)
    return model


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(ops=program)
def test_reads_equal_the_model(spark, ops):
    model = run(ops)
    log = spark.createDataFrame(model.log, LOG)
    n = len(model.log)
    for snapshot in {0, n // 2, n, n + 1}:
        assert {(r["sid"], r["pred"]): r["val"] for r in mvcc.scan_live(log, snapshot).collect()} == model.live(snapshot)
    assert {(r["sid"], r["pred"]): r["val"] for r in mvcc.scan_live_by_rank(log).collect()} == model.live(n)
    probes = [(s, p, t) for s in range(8) for p in range(3) for t in range(0, n + 2, 3)]
    found = mvcc.asof_join(log, spark.createDataFrame(probes, "sid bigint, pred bigint, snapshot bigint"), width=4)
    got = {(r["sid"], r["pred"], r["snapshot"]): r["val"] for r in found.collect()}
    assert got == {(s, p, t): v for s, p, t in probes if (v := model.get(s, p, t)) is not None}


def arrivals(spark, ops, start=0):
    rows = [(i + start, s, p, o, v if o == 0 else None, k) for i, (s, p, o, v, k) in enumerate(ops)]
    return spark.createDataFrame(rows, "arrival bigint, sid bigint, pred bigint, op smallint, val string, idem_key bigint")


def random_ops(seed, n=80):
    r = random.Random(seed)
    return [(r.randrange(8), r.randrange(3), int(r.random() < 0.25), f"v{i}", r.randrange(60)) for i in range(n)]


def contents(log):
    return sorted((r["seq"], r["sid"], r["pred"], r["op"], r["val"], r["idem_key"]) for r in log.read().collect())


def test_commits_equal_the_model_and_repeats_change_nothing(spark, tmp_path):
    ops = random_ops(1)
    log = FactLog(spark, str(tmp_path / "log"), ROWS)
    assert log.read().count() == 0 and mvcc.high_watermark(log.read()).first()["high"] == 0
    for b in range(3):
        batch = arrivals(spark, ops[b * 30 : b * 30 + 30], b * 30)
        log.commit(batch, b)
        log.commit(batch, b)  # sent again
    model = run(ops[:90])
    assert contents(log) == sorted(model.log)
    acks = {(r["idem_key"], r["seq"]) for r in log.acknowledge(arrivals(spark, ops)).collect()}
    assert acks == set(model.seen.items())


def test_a_batch_without_record_does_not_exist(spark, tmp_path):
    ops = random_ops(2)
    log = FactLog(spark, str(tmp_path / "log"), ROWS)
    log.commit(arrivals(spark, ops[:40]), 0)
    log.stage(arrivals(spark, ops[40:]))
    assert contents(log) == sorted(run(ops[:40]).log)
    again = FactLog(spark, str(tmp_path / "log"), ROWS)  # after a restart
    again.commit(arrivals(spark, ops[40:], 40), 1)
    assert contents(again) == sorted(run(ops).log)
    assert {r["idem_key"]: r["seq"] for r in idempotency.replayed(again.read()).collect()} == run(ops).seen


def test_twelve_writers_at_once(spark, tmp_path):
    """Every key once, sequences dense, each writer's rows in its order, and what is sent again counts once."""
    logs = [FactLog(spark, str(tmp_path / "log"), ROWS) for _ in range(3)]
    batches = [arrivals(spark, [(w, i, 0, f"w{w}", 5 * w + i) for i in range(6)], 100 - w) for w in range(12)]  # a key shared with the next
    with ThreadPoolExecutor(12) as pool:
        versions = list(pool.map(lambda w: logs[w % 3].commit(batches[w], f"writer {w}"), range(12)))
    rows = logs[0].read().collect()
    assert sorted(r["seq"] for r in rows) == list(range(1, 62)) and {r["idem_key"] for r in rows} == set(range(61)) and len(rows) == 61
    for w in range(12):
        assert [r["pred"] for r in sorted(rows, key=lambda r: r["seq"]) if r["sid"] == w] == sorted(r["pred"] for r in rows if r["sid"] == w)
    records = logs[1].commits().orderBy("version").collect()
    assert [r["version"] for r in records] == list(range(len(records))) and set(versions) == set(range(len(records)))
    assert sorted(t for r in records for t in r["tags"]) == sorted(f"writer {w}" for w in range(12))
    assert [logs[0].commit(batches[w], f"writer {w}") for w in range(12)] == versions and logs[2].read().count() == 61


def test_a_version_is_given_once(spark, tmp_path):
    """Two processes: each stages a batch, the second finds the version taken and numbers anew."""
    one, two = (FactLog(spark, str(tmp_path / "log"), ROWS) for _ in range(2))
    two.committer = log_module.Committer()  # as in another process
    staged = one.stage(arrivals(spark, [(1, 0, 0, "a", 1)]))
    assert two.commit(arrivals(spark, [(2, 0, 0, "b", 2)])) == 0
    assert not one.record(staged, 0)
    assert one.commit(arrivals(spark, [(1, 0, 0, "a", 1), (2, 0, 0, "c", 2)])) == 1
    assert contents(one) == [(1, 2, 0, 0, "b", 2), (2, 1, 0, 0, "a", 1)]


def test_a_failing_writer_fails_alone(spark, tmp_path):
    log = FactLog(spark, str(tmp_path / "log"), ROWS)
    good = arrivals(spark, [(1, 0, 0, "a", 1)])
    bad = good.withColumn("val", F.raise_error(F.lit("broken")))
    group = [log_module.Pending(good, None), log_module.Pending(bad, None), log_module.Pending(good.withColumn("idem_key", F.lit(7).cast("long")), None)]
    log._commit_group(group)
    assert [p.error is None for p in group] == [True, False, True] and {r["idem_key"] for r in log.read().collect()} == {1, 7}
    log.close()
    assert not log.is_healthy()
    with pytest.raises(Closed):
        log.commit(good)
    assert FactLog(spark, log.path, ROWS).commit(good) == 2


def test_subscribers_see_recorded_rows_only(spark, tmp_path):
    log = FactLog(spark, str(tmp_path / "log"), ROWS)
    log.commit(arrivals(spark, [(1, 0, 0, "a", 1)]))
    seen = {"all": [], "now": []}

    def sync():
        for name in seen:
            changes.subscribe(log, lambda rows, name=name: seen[name].extend(r["seq"] for r in rows.collect()), str(tmp_path / name), from_now=name == "now").awaitTermination()

    sync()
    assert seen == {"all": [1], "now": []}
    log.stage(arrivals(spark, [(5, 0, 0, "lost", 5), (6, 0, 0, "lost", 6)]))
    log.commit(arrivals(spark, [(2, 0, 0, "b", 2), (3, 0, 1, None, 3)]))
    sync()
    sync()
    assert seen == {"all": [1, 2, 3], "now": [2, 3]}


def test_keys_far_from_a_batch_are_not_read(spark, tmp_path):
    log = FactLog(spark, str(tmp_path / "log"), ROWS)
    for b in range(3):
        log.commit(arrivals(spark, [(i, 0, 0, "a", 100 * b + i) for i in range(10)]))
    log.files.delete(f"{log.path}/rows/batch_id={log.commits().where('version = 0').first()['batch_id']}")
    log.commit(arrivals(spark, [(i, 0, 0, "b", 205 + i) for i in range(10)]))
    assert log.newest()["n"] == 5 and log.newest()["low"] == 31


def test_empty_batches(spark, tmp_path):
    log = FactLog(spark, str(tmp_path / "log"), ROWS)
    log.commit(arrivals(spark, random_ops(3)).limit(0))
    assert log.read().count() == 0
    assert log.commit(arrivals(spark, random_ops(3))) == 1


def test_numbers_are_dense_and_in_order(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("at")).repartition(5)
    rows = sequence.number(df, ["at"], start=11).orderBy("at").collect()
    assert [r["seq"] for r in rows] == list(range(11, 1011))
    assert sequence.number(df.limit(0), ["at"]).count() == 0


@pytest.mark.parametrize(("seqs", "want"), [([], 0), ([2, 3], 0), ([1], 1), ([3, 1, 2, 2, 5], 3), ([0, 1, 2], 2)])
def test_watermark_is_the_contiguous_prefix(spark, seqs, want):
    df = spark.createDataFrame([(s,) for s in seqs], "seq bigint")
    assert mvcc.contiguous_watermark(df).first()["watermark"] == want


def test_seek_goes_to_newer_versions_first(spark):
    model = run(random_ops(4))
    log = spark.createDataFrame(model.log, LOG)
    ordered = sorted(model.log, key=lambda r: (r[1], r[2], -r[0]))
    for sid, pred, seq in ((0, 0, 0), (3, 1, 20), (7, 2, 10**9), (9, 0, 0)):
        want = next((r[0] for r in ordered if (r[1], r[2], -r[0]) >= (sid, pred, -seq)), None)
        row = mvcc.seek_ge(log, sid, pred, seq).first()
        assert (row["seq"] if row else None) == want


@pytest.mark.parametrize("cut", [0, 1, 7, 40, 41, 10**6])
def test_frames_are_read_up_to_a_torn_one(spark, cut, tmp_path):
    whole = [frames.encode(i, i % 3, 0, i % 2, i, i, 1.0, f"v{i}".encode()) for i in range(6)]
    data = b"".join(whole)
    data = data[: max(0, len(data) - cut)]
    kept, size = 0, 0
    for frame in whole:
        size += len(frame)
        kept += size <= len(data)
    assert [r[0] for r in frames.decode(data)] == list(range(kept))
    (tmp_path / "a.log").write_bytes(data)
    spark.dataSource.register(frames.FrameSource)
    rows = spark.read.format("framelog").option("paths", str(tmp_path / "a.log")).load().collect()
    assert sorted(r["seq"] for r in rows) == list(range(kept))
    back = frames.read_binary(spark.read.format("binaryFile").load(str(tmp_path / "a.log"))).collect()
    assert sorted(r["seq"] for r in back) == list(range(kept))


def test_a_flipped_bit_ends_a_frame_file():
    data = bytearray(b"".join(frames.encode(i, 0, 0, 0, 0, i, 1.0, b"v") for i in range(3)))
    data[len(data) // 2] ^= 1
    assert [r[0] for r in frames.decode(bytes(data))] == [0]


def test_forms_of_json(spark, tmp_path):
    item = '{"sid": 1, "text": "a"}'
    full = '{"sid": 2, "text": "b", "category": 260, "amount": -5}'
    want = {(1, 0, 0, "a"), (2, 4, -5, "b")}
    for body in (f"[{item}, {full}]", f'{{"grains": [{item}, {full}]}}', f"{item}\n\n{full}\n"):
        assert {tuple(r) for r in ingest.from_body(spark, body).collect()} == want
    assert {tuple(r) for r in ingest.from_body(spark, item).collect()} == {(1, 0, 0, "a")}
    for body in ('[{"sid": 1}]', f'[{item}, {{"text": "x"}}]', "nonsense", '{"sid": -1, "text": "x"}'):
        with pytest.raises(ValueError):
            ingest.from_body(spark, body)
    (tmp_path / "n.json").write_text(f"{item}\n{full}\n")
    assert {tuple(r) for r in ingest.read_lines(spark, str(tmp_path / "n.json")).collect()} == want
    (tmp_path / "a.json").write_text(f"[{item},\n {full}]")
    (tmp_path / "g.json").write_text(f'{{"grains": [{item}, {full}]}}')
    for name in ("a.json", "g.json"):
        assert {tuple(r) for r in ingest.read_documents(spark, str(tmp_path / name)).collect()} == want
    bad = ingest.from_lines(spark.createDataFrame([('{"sid": "x", "text": "t"}',), (item,)], "value string"))
    assert ingest.invalid(bad).count() == 1
    odd = ingest.from_lines(spark.createDataFrame([('{"sid": 5, "text": "t", "category": -3, "amount": 1.5}',)], "value string"))
    assert tuple(odd.first()) == (5, 0, 0, "t")


def test_a_stream_keeps_state_in_step(spark, tmp_path):
    schema = "seq bigint, sid bigint, pred bigint, op smallint, embedding array<float>, idem_key bigint"
    log, path = FactLog(spark, str(tmp_path / "log"), schema), str(tmp_path / "state")
    r = np.random.default_rng(0)
    for b in range(4):
        state = changes.Materializer(log, 2, path, buckets=4)  # each time after a restart
        rows = [(b * 20 + i, int(r.integers(8)), 0, int(r.random() < 0.3), [1.0, 2.0] if r.random() < 0.8 else [1.0], b * 20 + i) for i in range(20)]
        batch = spark.createDataFrame(rows, "arrival bigint, sid bigint, pred bigint, op smallint, embedding array<float>, idem_key bigint")
        log.stage(batch)  # a writer that is lost
        log.commit(batch)
        if b == 1:
            assert state.wait_for((b + 1) * 20, 60) and not state.wait_for(10**6, 0.2)
        assert state.sync() == (b + 1) * 20 and state.is_healthy()
        assert state.in_step()
        state.merge(log.commits())  # a batch that is given again
        assert state.in_step() and state.watermark() == (b + 1) * 20
    folders = set(state.pointer()["folders"].values())
    assert {f"{p.parent.name}/{p.name}" for p in (tmp_path / "state").glob("upto=*/bucket=*")} == folders and len(folders) <= 4


def test_group_commit_of_a_stream(spark, tmp_path):
    ops = random_ops(6)
    log = FactLog(spark, str(tmp_path / "log"), ROWS)
    source = str(tmp_path / "in")
    for b in range(2):
        arrivals(spark, ops[b * 40 : b * 40 + 40], b * 40).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(spark.read.parquet(source).schema).parquet(source)
        changes.group_commit(log, stream, str(tmp_path / "ck")).awaitTermination()
    assert contents(log) == sorted(run(ops).log)


def test_a_stateful_stream_numbers_like_the_model(spark, tmp_path):
    ops = random_ops(7, 40)
    arrivals(spark, ops).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("arrival bigint, idem_key bigint").parquet(str(tmp_path / "in"))
    try:
        changes.numbered_stream(spark, stream, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert {(r["idem_key"], r["seq"]) for r in rows} == set(run(ops).seen.items())
    assert sum(r["fresh"] for r in rows) == len(run(ops).seen) and len(rows) == len(ops)
