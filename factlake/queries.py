"""Registered queries over the driver's tables, each with its DuckDB twin where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import codecs, hashing
from .functions.distance import l2, l2_sq
from .functions.embed import embed_text
from .operators import ann, blocks, catalog, disclosure, governance, graph, idempotency, knn, mvcc, near, sequence
from .plans import planner
from .plans import store as text_store
from .sources import frames, ingest, views
from .sources.log import FactLog
from .storage import kept, shared_path
from .streaming import changes

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

DIM, K, CATEGORY = 64, 10, 3


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a function under its name, with its twin."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


# Views of FIXTURES, as common table expressions.

VEC = """grains AS (
  SELECT vec_id AS sid, 0::BIGINT AS pred, label AS category, embedding, vec_id + 1 AS seq, 257::BIGINT AS val_bytes FROM embeddings
)"""
LOG = """log AS (
  SELECT event_id + 1 AS seq, user_id AS sid,
    CASE event_type WHEN 'signup' THEN 0 WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'purchase' THEN 3 ELSE event_id % 4 END::BIGINT AS pred,
    CASE WHEN event_type = 'error' THEN 1 ELSE 0 END::SMALLINT AS op,
    CASE WHEN event_type = 'error' THEN NULL ELSE props END AS val,
    least(value / 500, 1.0) AS c, epoch_us(ts) AS t_valid, event_id AS idem_key
  FROM events
)"""
ARRIVALS = f"""{LOG}, arrivals AS (
  SELECT sid, pred, op, val, idem_key, idem_key AS arrival FROM log
  UNION ALL SELECT sid, pred, op, CASE WHEN op = 0 THEN val || '!' END, idem_key, idem_key + 1000000000 FROM log WHERE idem_key % 10 = 0
), firsts AS (SELECT DISTINCT ON (idem_key) * FROM arrivals ORDER BY idem_key, arrival)"""
NEWEST = f"{LOG}, newest AS (SELECT DISTINCT ON (sid, pred) * FROM log ORDER BY sid, pred, seq DESC)"
L2SQ = "list_sum(list_transform(range(1, 65), lambda i: (g.embedding[i]::DOUBLE - q.v[i]::DOUBLE) * (g.embedding[i]::DOUBLE - q.v[i]::DOUBLE)))"
DIST = f"{VEC}, q AS (SELECT embedding AS v FROM embeddings WHERE vec_id = 0), dists AS (SELECT g.*, {L2SQ} AS dist FROM grains g, q)"


def log_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.log_events(spark, sf_dir)


def vecs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.grains_vec(spark, sf_dir)


def ask(spark: SparkSession, sf_dir: str) -> list[float]:
    return views.query_vector(spark, sf_dir)


# Distances and nearest neighbours.


@query(f"WITH {DIST} SELECT sid, dist FROM dists")
def l2_sq_all(spark, sf_dir):
    """Distance of every vector to that of row 0."""
    return knn.with_distance(vecs(spark, sf_dir), ask(spark, sf_dir)).select("sid", "dist")


def _pairs(spark, sf_dir) -> DataFrame:
    table = vecs(spark, sf_dir)
    following = table.select((F.col("sid") - 1).alias("sid"), F.col("embedding").alias("other"))
    return table.join(following, "sid")


_PAIRS = f"""WITH {VEC}, pairs AS (SELECT g.sid, g.embedding, h.embedding AS v FROM grains g JOIN grains h ON h.sid = g.sid + 1),
d AS (SELECT g.sid, {L2SQ.replace("q.v", "g.v")} AS dist FROM pairs g)"""


@query(f"{_PAIRS} SELECT sid, dist FROM d")
def l2_sq_pairs(spark, sf_dir):
    """Squared distance of each vector to the next."""
    return _pairs(spark, sf_dir).select("sid", l2_sq(F.col("embedding"), F.col("other")).alias("dist"))


@query(f"{_PAIRS} SELECT sid, round(sqrt(dist), 12) AS dist FROM d")
def l2_pairs(spark, sf_dir):
    return _pairs(spark, sf_dir).select("sid", F.round(l2(F.col("embedding"), F.col("other")), 12).alias("dist"))


QUERIES["l2_sq"], ORACLES["l2_sq"] = QUERIES.pop("l2_sq_pairs"), ORACLES.pop("l2_sq_pairs")
QUERIES["l2"], ORACLES["l2"] = QUERIES.pop("l2_pairs"), ORACLES.pop("l2_pairs")


@query(f"WITH {DIST} SELECT sid, category, dist FROM dists ORDER BY dist, sid LIMIT 10")
def knn_exact(spark, sf_dir):
    return knn.nearest(vecs(spark, sf_dir), ask(spark, sf_dir), K).select("sid", "category", "dist")


@query(f"WITH {DIST} SELECT sid, category, dist FROM dists ORDER BY dist, sid LIMIT 10")
def knn_sharded(spark, sf_dir):
    return knn.nearest_by_shard(vecs(spark, sf_dir), ask(spark, sf_dir), K, 8).select("sid", "category", "dist")


@query(
    f"""WITH {VEC}, q AS (SELECT vec_id AS query_id, embedding AS v FROM embeddings WHERE vec_id % 20 = 0),
d AS (SELECT query_id, g.sid, {L2SQ} AS dist FROM grains g, q),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, sid) AS place FROM d)
SELECT query_id, sid, round(dist, 9) AS dist, place::INT AS place FROM r WHERE place <= 10"""
)
def knn_batch(spark, sf_dir):
    """The ten nearest of every vector for each query whose id is divisible by 20."""
    table = vecs(spark, sf_dir)
    queries = table.where(F.col("sid") % 20 == 0).select(F.col("sid").alias("query_id"), F.col("embedding").alias("vector"))
    return knn.nearest_batch(table, queries, K).select("query_id", "sid", F.round("dist", 9).alias("dist"), "place")


def _deleted(spark, sf_dir) -> DataFrame:
    """A vector log in which every fifth sid was deleted, and every seventh rewritten too short."""
    puts = vecs(spark, sf_dir).withColumn("op", F.lit(0).cast("smallint"))
    gone = puts.where("sid % 5 = 0").withColumns({"op": F.lit(1).cast("smallint"), "seq": F.col("seq") + 10**6, "embedding": F.lit(None).cast("array<float>")})
    short = puts.where("sid % 7 = 0").withColumns({"seq": F.col("seq") + 10**7, "embedding": F.slice("embedding", 1, DIM - 1)})
    return puts.unionByName(gone).unionByName(short)


@query(f"WITH {DIST} SELECT sid, dist FROM dists WHERE sid % 5 != 0 AND sid % 7 != 0 ORDER BY dist, sid LIMIT 10")
def knn_after_delete(spark, sf_dir):
    return knn.nearest(knn.psi(_deleted(spark, sf_dir), DIM), ask(spark, sf_dir), K).select("sid", "dist")


@query(f"WITH {VEC} SELECT sid, pred, seq FROM grains WHERE sid % 5 != 0 AND sid % 7 != 0")
def psi_view(spark, sf_dir):
    return knn.psi(_deleted(spark, sf_dir), DIM).select("sid", "pred", "seq")


@query(f"WITH {VEC} SELECT sid, pred, seq FROM grains WHERE sid % 5 != 0 AND sid % 7 != 0")
def index_rebuild(spark, sf_dir):
    """The vector view, written anew from the log."""
    return kept(knn.psi(_deleted(spark, sf_dir), DIM).select("sid", "pred", "seq"))


@query(f"WITH {VEC} SELECT count(*) AS n FROM grains WHERE sid % 5 != 0 AND sid % 7 != 0")
def index_len(spark, sf_dir):
    return knn.psi(_deleted(spark, sf_dir), DIM).agg(F.count("*").alias("n"))


# The hybrid query.


@query(f"WITH {DIST} SELECT sid, category, dist FROM dists WHERE category = 3 ORDER BY dist, sid LIMIT 10")
def near_select(spark, sf_dir):
    """Flagship: the ten nearest facts of a category."""
    found = near.near_select(vecs(spark, sf_dir), ask(spark, sf_dir), K, F.col("category") == CATEGORY)
    return found.select("sid", "category", "dist")


@query(
    f"""WITH {DIST}, cands AS (SELECT * FROM dists ORDER BY dist, sid LIMIT 450)
SELECT sid, category, dist FROM cands WHERE category = 3 ORDER BY dist, sid LIMIT 10"""
)
def near_select_postfilter(spark, sf_dir):
    facts = vecs(spark, sf_dir)
    found = near.near_select_postfilter(facts, facts, ask(spark, sf_dir), K, 45, F.col("category") == CATEGORY)
    return found.select("sid", "category", "dist")


@query(f"WITH {DIST} SELECT sid, category, dist FROM dists WHERE embedding[1] > 0 AND category IN (1, 4, 7) ORDER BY dist, sid LIMIT 10")
def near_select_lambda(spark, sf_dir):
    where = (F.col("embedding")[0] > 0) & F.col("category").isin(1, 4, 7)
    return near.near_select(vecs(spark, sf_dir), ask(spark, sf_dir), K, where).select("sid", "category", "dist")


@query(f"WITH {DIST} SELECT sid, category, dist FROM dists ORDER BY dist, sid LIMIT 10")
def filter_any(spark, sf_dir):
    return near.near_select(vecs(spark, sf_dir), ask(spark, sf_dir), K, near.filter_any()).select("sid", "category", "dist")


@query("SELECT doc_id FROM documents WHERE left(text, 1) = 'T'")
def filter_header_eq(spark, sf_dir):
    """Documents whose first byte is T."""
    docs = views.read(spark, sf_dir, "documents").select("doc_id", F.encode("text", "UTF-8").alias("val"))
    return docs.where(near.filter_header_eq("val", 0, ord("T"))).select("doc_id")


@query(
    f"""WITH {DIST} SELECT sid, category, sid * 10 AS amount, dist AS distance FROM dists
WHERE category = 2 AND sid * 10 >= 500 AND sid * 10 <= 4000 ORDER BY dist, sid LIMIT 5"""
)
def store_query(spark, sf_dir):
    """Category and inclusive bounds of the amount, by vector; ``store_query_text`` asks by text."""
    facts = vecs(spark, sf_dir).withColumn("amount", F.col("sid") * 10)
    found = near.near_select(facts, ask(spark, sf_dir), 5, near.filter_store(2, 500, 4000))
    return found.select("sid", "category", "amount", F.col("dist").alias("distance"))


def _text_twin() -> str:
    return f"""WITH texts AS (SELECT doc_id AS id, text FROM documents WHERE lang = 'en' UNION ALL SELECT -1, 'the and attion to'), {_EMBED},
v AS (SELECT p.id, pos, (x / norm)::FLOAT::DOUBLE AS x FROM places p JOIN norms n USING (id)),
every AS (SELECT t.id, g.pos::INT AS pos FROM (SELECT DISTINCT id FROM v WHERE id >= 0) t, range(0, 64) g(pos)),
d AS (SELECT e.id, round(sum((coalesce(a.x, 0) - coalesce(q.x, 0)) ** 2), 9) AS distance FROM every e LEFT JOIN v a ON a.id = e.id AND a.pos = e.pos
  LEFT JOIN v q ON q.id = -1 AND q.pos = e.pos GROUP BY e.id)
SELECT d.id AS sid, 1 AS category, n_chars AS amount, text, distance FROM d JOIN documents ON doc_id = d.id ORDER BY distance, sid LIMIT 5"""


@query()
def store_query_text(spark, sf_dir):
    facts = text_store.facts_of(views.grains_text(spark, sf_dir))
    found = text_store.hits(facts, "the and attion to", 5, category=1)
    return found.withColumn("distance", F.round("distance", 9))


@query(
    f"""WITH {DIST}, s AS (SELECT count(*) FILTER (category = 3) / count(*) AS sel FROM grains),
p AS (SELECT sel, ceil(4.5 / greatest(least(sel, 1.0), 0.0001))::BIGINT AS over_fetch FROM s),
cands AS (SELECT * FROM dists ORDER BY dist, sid LIMIT (SELECT 10 * over_fetch FROM p))
SELECT sid, category, dist, p.over_fetch, 128::BIGINT AS ef, 10 * p.over_fetch AS est_candidates
FROM cands, p WHERE category = 3 ORDER BY dist, sid LIMIT 10"""
)
def query_planned(spark, sf_dir):
    """Selectivity from the catalog, the plan for recall 0.9, then the post-filter query."""
    facts = vecs(spark, sf_dir)
    sel = catalog.selectivity(facts, CATEGORY).first()["selectivity"]
    made = planner.plan(sel, K, 0.90)
    found = near.near_select_postfilter(facts, facts, ask(spark, sf_dir), K, made.over_fetch, F.col("category") == CATEGORY)
    plan = [F.lit(v).cast("long").alias(n) for n, v in (("over_fetch", made.over_fetch), ("ef", made.ef), ("est_candidates", made.est_candidates))]
    return found.select("sid", "category", "dist", *plan)


@query(
    """WITH s AS (SELECT unnest([0.0, 0.00001, 0.01, 0.02, 0.04, 0.15, 0.3, 0.5, 1.0])::DOUBLE AS selectivity),
t AS (SELECT unnest([0.5, 0.8, 0.9, 0.95, 0.99, 1.0])::DOUBLE AS target),
m AS (SELECT *, greatest(least(selectivity, 1.0), 0.0001)::DOUBLE AS sel,
  CASE WHEN target >= 0.99 THEN 12 WHEN target >= 0.95 THEN 7 WHEN target >= 0.9 THEN 4.5 WHEN target >= 0.8 THEN 2.5 ELSE 1.5 END::DOUBLE AS margin,
  CASE WHEN target >= 0.99 THEN 256 WHEN target >= 0.95 THEN 192 WHEN target >= 0.9 THEN 128 ELSE 64 END::BIGINT AS ef FROM s, t),
o AS (SELECT *, least(greatest(ceil(margin / sel), 1), 4096)::BIGINT AS over_fetch FROM m)
SELECT selectivity, target, over_fetch, ef, sel AS est_selectivity, 10 * over_fetch AS est_candidates FROM o"""
)
def plan_params(spark, sf_dir):
    s = spark.createDataFrame([(x,) for x in (0.0, 0.00001, 0.01, 0.02, 0.04, 0.15, 0.3, 0.5, 1.0)], "selectivity double")
    targets = F.explode(F.array(*[F.lit(x) for x in (0.5, 0.8, 0.9, 0.95, 0.99, 1.0)])).alias("target")
    return s.select("selectivity", targets).withColumns(planner.plan_columns(F.col("selectivity"), F.lit(K), F.col("target")))


@query(f"WITH {VEC} SELECT category, count(*) AS n FROM grains GROUP BY category")
def catalog_counts(spark, sf_dir):
    return catalog.category_counts(vecs(spark, sf_dir))


@query(f"WITH {VEC} SELECT count(*) FILTER (category = 3) AS n, count(*) AS total, count(*) FILTER (category = 3) / count(*) AS selectivity FROM grains")
def selectivity(spark, sf_dir):
    return catalog.selectivity(vecs(spark, sf_dir), CATEGORY)


# Approximate strategies: rows-only checks; their recall is tested.


@query()
def knn_ivf(spark, sf_dir):
    rows, centres = ann.build_ivf(vecs(spark, sf_dir), 16)
    return ann.ivf(kept(rows), kept(centres), ask(spark, sf_dir), K, 12).select("sid", "dist")


@query()
def knn_lsh(spark, sf_dir):
    return ann.lsh(vecs(spark, sf_dir), ask(spark, sf_dir), K)


@query()
def recall_at_k(spark, sf_dir):
    """Recall of the inverted file at three quarters of its cells, for ids divisible by 20."""
    table = vecs(spark, sf_dir)
    rows, centres = ann.build_ivf(table, 16)
    asked = table.where(F.col("sid") % 20 == 0).select(F.col("sid").alias("query_id"), F.col("embedding").alias("vector"))
    return knn.recall(knn.nearest_batch(table, asked, K), ann.ivf_batch(kept(rows), kept(centres), asked, K, 12), K)


@query()
def knn_graph(spark, sf_dir):
    """The ten nearest of row 0 by the neighbour graphs."""
    shards = kept(graph.build(vecs(spark, sf_dir), DIM))
    asked = vecs(spark, sf_dir).where("sid = 0").select(F.col("sid").alias("query_id"), F.col("embedding").alias("vector"))
    return graph.search_batch(shards, asked, K, 128).select("sid", "dist")


@query()
def recall_graph(spark, sf_dir):
    """Recall of the neighbour graphs at effort 128, for ids divisible by 20."""
    table = vecs(spark, sf_dir)
    asked = table.where(F.col("sid") % 20 == 0).select(F.col("sid").alias("query_id"), F.col("embedding").alias("vector"))
    return knn.recall(knn.nearest_batch(table, asked, K), graph.search_batch(kept(graph.build(table, DIM)), asked, K, 128), K)


@query(
    """WITH o AS (SELECT list(n_chars ORDER BY n_chars) AS l FROM documents), p AS (SELECT unnest([50, 90, 99])::INT AS p)
SELECT p, l[floor(p / 100.0::DOUBLE * (len(l) - 1) + 0.5)::BIGINT + 1] AS value FROM o, p"""
)
def percentile_rank(spark, sf_dir):
    """Nearest-rank percentiles of the documents' lengths."""
    docs = views.read(spark, sf_dir, "documents")
    one = [knn.percentile(docs, "n_chars", p).select(F.lit(p).alias("p"), "value") for p in (50, 90, 99)]
    return one[0].union(one[1]).union(one[2])


# Versions.


@query(f"WITH {NEWEST} SELECT sid, pred, seq, val, c, t_valid FROM newest WHERE op = 0")
def mvcc_scan_live(spark, sf_dir):
    return mvcc.scan_live(log_of(spark, sf_dir)).select("sid", "pred", "seq", "val", "c", "t_valid")


@query(f"WITH {NEWEST} SELECT sid, pred, seq, val, c, t_valid FROM newest WHERE op = 0")
def mvcc_row_number(spark, sf_dir):
    return mvcc.scan_live_by_rank(log_of(spark, sf_dir)).select("sid", "pred", "seq", "val", "c", "t_valid")


@query(
    f"""WITH {LOG}, s AS (SELECT max(seq) // 2 AS snap FROM log),
n AS (SELECT DISTINCT ON (sid, pred) log.* FROM log, s WHERE seq <= snap ORDER BY sid, pred, seq DESC)
SELECT sid, pred, seq, val FROM n WHERE op = 0"""
)
def mvcc_scan_asof(spark, sf_dir):
    log = log_of(spark, sf_dir)
    return mvcc.scan_live(log, mvcc.high_watermark(log).first()["high"] // 2).select("sid", "pred", "seq", "val")


@query(f"WITH {LOG}, n AS (SELECT * FROM log WHERE sid = 8 AND pred = 1 AND seq <= (SELECT max(seq) // 2 FROM log) ORDER BY seq DESC LIMIT 1) SELECT sid, pred, seq, val FROM n WHERE op = 0")
def mvcc_get_at(spark, sf_dir):
    log = log_of(spark, sf_dir)
    return mvcc.get_at(log, 8, 1, mvcc.high_watermark(log).first()["high"] // 2).select("sid", "pred", "seq", "val")


@query(f"WITH {NEWEST} SELECT sid, pred, seq, val FROM newest WHERE op = 0 AND sid = 7 AND pred = 2")
def mvcc_get_strong(spark, sf_dir):
    return mvcc.get_at(log_of(spark, sf_dir), 7, 2).select("sid", "pred", "seq", "val")


@query(
    f"""WITH {LOG}, n AS (SELECT max(seq) AS n FROM log), snaps AS (SELECT unnest([n // 4, n // 2, n]) AS snapshot FROM n),
probes AS (SELECT DISTINCT sid, pred, snapshot FROM log, snaps),
j AS (SELECT p.sid, p.pred, p.snapshot, l.seq, l.op, l.val FROM probes p ASOF JOIN log l ON l.sid = p.sid AND l.pred = p.pred AND p.snapshot >= l.seq)
SELECT sid, pred, snapshot, seq, val FROM j WHERE op = 0"""
)
def mvcc_asof_join(spark, sf_dir):
    return mvcc.asof_join(log_of(spark, sf_dir), views.probes(spark, sf_dir), 4096).select("sid", "pred", "snapshot", "seq", "val")


@query(f"WITH {LOG} SELECT sid, pred, count(*) AS versions FROM log GROUP BY ALL")
def version_count(spark, sf_dir):
    return mvcc.version_count(log_of(spark, sf_dir))


@query(f"WITH {LOG} SELECT count(*) AS total FROM log")
def total_versions(spark, sf_dir):
    return mvcc.total_versions(log_of(spark, sf_dir))


@query(f"WITH {LOG} SELECT max(seq) AS high, max(seq) + 1 AS next FROM log")
def high_watermark(spark, sf_dir):
    return mvcc.high_watermark(log_of(spark, sf_dir))


@query(f"WITH {LOG} SELECT sid, pred, seq, op, val FROM log ORDER BY sid, pred, seq DESC")
def scan_all(spark, sf_dir):
    return mvcc.scan_all(log_of(spark, sf_dir)).select("sid", "pred", "seq", "op", "val")


@query(f"WITH {LOG} SELECT sid, pred, seq, op, val FROM log WHERE (sid, pred, -seq) >= (9, 2, -500) ORDER BY sid, pred, seq DESC LIMIT 1")
def kv_seek_ge(spark, sf_dir):
    return mvcc.seek_ge(log_of(spark, sf_dir), 9, 2, 500).select("sid", "pred", "seq", "op", "val")


@query(f"WITH {LOG} SELECT min(seq) - 1 AS watermark FROM log WHERE seq % 777 = 0")
def watermark_prefix(spark, sf_dir):
    """Watermark of a log that lacks every 777th sequence."""
    return mvcc.contiguous_watermark(log_of(spark, sf_dir).where("seq % 777 != 0"))


@query(f"WITH {LOG} SELECT sid, pred, seq, op, val FROM log")
def cdc_feed(spark, sf_dir):
    return changes.feed(log_of(spark, sf_dir))


# Writes.

ROWS = "seq bigint, sid bigint, pred bigint, op smallint, val string, idem_key bigint"


def arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.log_arrivals(spark, sf_dir).select("sid", "pred", "op", "val", "idem_key", "arrival")


def new_log(spark: SparkSession) -> FactLog:
    return FactLog(spark, shared_path(spark, "log"), ROWS)


@query(f"WITH {ARRIVALS} SELECT idem_key, sid, pred, op, val FROM firsts")
def idem_dedup(spark, sf_dir):
    return idempotency.first_arrivals(arrivals(spark, sf_dir)).drop("arrival")


@query(f"WITH {ARRIVALS} SELECT idem_key, row_number() OVER (ORDER BY arrival) AS seq FROM firsts")
def seq_assign(spark, sf_dir):
    return sequence.number(idempotency.first_arrivals(arrivals(spark, sf_dir)), ["arrival"]).select("idem_key", "seq")


@query(f"WITH {ARRIVALS} SELECT row_number() OVER (ORDER BY arrival) AS seq, sid, pred, op, val, idem_key FROM firsts")
def write_commit(spark, sf_dir):
    """One batch with repeats, committed and read again."""
    log = new_log(spark)
    log.commit(arrivals(spark, sf_dir))
    return log.read().drop("batch_id")


@query(f"WITH {ARRIVALS} SELECT row_number() OVER (ORDER BY sid % 3, arrival) AS seq, sid, pred, op, val, idem_key FROM firsts")
def group_commit(spark, sf_dir):
    """Three groups, then one that repeats rows of all three, each committed twice."""
    log, rows = new_log(spark), arrivals(spark, sf_dir)
    group = F.when(F.col("arrival") >= 10**9, 3).otherwise(F.col("sid") % 3)
    for g in range(4):
        for _ in range(2):
            log.commit(rows.where(group == g), g)
    return log.read().drop("batch_id")


@query(f"WITH {ARRIVALS} SELECT row_number() OVER (ORDER BY arrival) AS seq, sid, pred, op, val, idem_key FROM firsts WHERE op = 0")
def recovery_prefix(spark, sf_dir):
    """All puts were committed, all deletes staged, but their writer lost before the record: they
    aren't in the log."""
    log, rows = new_log(spark), arrivals(spark, sf_dir)
    log.commit(rows.where("op = 0"))
    log.stage(rows.where("op = 1"))
    return log.read().drop("batch_id")


@query(f"WITH {ARRIVALS}, numbered AS (SELECT idem_key, row_number() OVER (ORDER BY arrival) AS seq FROM arrivals) SELECT idem_key, min(seq) AS seq FROM numbered GROUP BY idem_key")
def recovery_idem(spark, sf_dir):
    """What a restart remembers of a log in which keys occur twice."""
    return idempotency.replayed(sequence.number(arrivals(spark, sf_dir), ["arrival"]))


@query(f"WITH {LOG} SELECT seq, sid, pred, op, t_valid, idem_key, val FROM log")
def wal_scan(spark, sf_dir):
    """The log as framed files with a torn tail each, read up to it."""

    def write(batches):
        import pandas as pd

        for batch in batches:
            data = b"".join(
                frames.encode(int(r.seq), int(r.sid), int(r.pred), int(r.op), int(r.t_valid), int(r.idem_key), float(r.c), (r.val or "").encode())
                for r in batch.itertuples()
            )
            yield pd.DataFrame({"content": [data + frames.encode(0, 0, 0, 0, 0, 0, 0.0, b"torn")[:-1]]})

    files = log_of(spark, sf_dir).mapInPandas(write, "content binary")
    back = frames.read_binary(files)
    return back.select("seq", "sid", "pred", "op", "t_valid", "idem_key", F.decode("val", "UTF-8").alias("val"))


@query(
    """SELECT doc_id AS sid, CASE WHEN doc_id % 3 = 0 THEN 0 ELSE doc_id % 256 END::INT AS category,
CASE WHEN doc_id % 4 = 0 THEN 0 ELSE n_chars END AS amount, text FROM documents"""
)
def ingest_ndjson(spark, sf_dir):
    """Documents as JSON lines, some without category or amount, parsed with their defaults."""
    docs = views.read(spark, sf_dir, "documents")
    item = F.struct(
        F.col("doc_id").alias("sid"),
        "text",
        F.when(F.col("doc_id") % 3 != 0, F.col("doc_id") % 256).alias("category"),
        F.when(F.col("doc_id") % 4 != 0, F.col("n_chars")).alias("amount"),
    )
    return ingest.from_lines(docs.select(F.to_json(item).alias("value")))


@query("SELECT 2 * count(*) AS given, count(DISTINCT doc_id) AS new, count(DISTINCT doc_id) FILTER (length(text) > 0) AS indexed FROM documents")
def store_load(spark, sf_dir):
    """A store loaded twice with the same texts: the second load changes nothing."""
    store, texts = text_store.Store(spark, shared_path(spark, "store")), views.grains_text(spark, sf_dir)
    one, two = store.load(texts), store.load(texts)
    return spark.createDataFrame([(one.given + two.given, one.new + two.new, store.indexed())], "given bigint, new bigint, indexed bigint")


@query("SELECT count(*) AS indexed FROM documents WHERE length(text) > 0")
def store_stats(spark, sf_dir):
    facts = text_store.facts_of(views.grains_text(spark, sf_dir))
    return facts.where(F.size("embedding") == text_store.DIM).agg(F.count("*").alias("indexed"))


@query(f"WITH {ARRIVALS} SELECT idem_key, sid, pred, op, val, (SELECT count(*) FROM firsts) AS high, true AS dense FROM firsts")
def commit_concurrent(spark, sf_dir):
    """Twelve writers at once, each with a twelfth of the keys, first rows and repeats alike: every key
    is there once, with its first row, and the sequences have no gap."""
    log, rows = new_log(spark), arrivals(spark, sf_dir)
    with ThreadPoolExecutor(12) as pool:
        list(pool.map(lambda i: log.commit(rows.where(F.pmod("idem_key", F.lit(12)) == i)), range(12)))
    out = log.read()
    facts = out.agg(F.max("seq").alias("high"), (F.count_distinct("seq") == F.max("seq")).alias("dense"))
    return out.select("idem_key", "sid", "pred", "op", "val").crossJoin(F.broadcast(facts))  # one row


@query(
    f"""WITH {ARRIVALS}, numbered AS (SELECT *, row_number() OVER (ORDER BY sid % 3, arrival) AS seq FROM firsts)
SELECT (SELECT count(*) FROM (SELECT DISTINCT sid, pred FROM numbered)) AS keys, (SELECT max(seq) FROM numbered) AS watermark, true AS in_step"""
)
def stream_materialize(spark, sf_dir):
    """State kept by a stream over the syncs of a log that grows by three groups and one of rows sent
    again, with a batch staged and never recorded, equals a batch read of the log."""
    log, rows = new_log(spark), arrivals(spark, sf_dir)
    state = changes.Materializer(log, 0)
    group = F.when(F.col("arrival") >= 10**9, 3).otherwise(F.col("sid") % 3)
    for g in range(4):
        log.commit(rows.where(group == g), g)
        if g == 1:
            log.stage(rows.where(group == 2))
        if g:
            watermark = state.sync()
    have, want = state.state().select("sid", "pred", "seq"), mvcc.newest(log.read()).select("sid", "pred", "seq")
    same = have.exceptAll(want).isEmpty() and want.exceptAll(have).isEmpty()
    return spark.createDataFrame([(have.count(), watermark, same)], "keys bigint, watermark bigint, in_step boolean")


# Staged results.

_PINNED = f"""WITH {DIST}, top AS (SELECT * FROM dists ORDER BY dist, sid LIMIT 40),
pinned AS (SELECT *, row_number() OVER (ORDER BY dist, sid) - 1 AS rank, val_bytes // 4 + 8 AS tokens FROM top)"""


def pinned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return disclosure.ranked(knn.nearest(vecs(spark, sf_dir), ask(spark, sf_dir), 40))


@query(
    f"""{_PINNED}, shown AS (SELECT sum(tokens) AS t FROM pinned WHERE rank % 8 = 0), a AS (SELECT list(dist ORDER BY dist) AS d, sum(tokens) AS full_tokens FROM pinned)
SELECT len(d) AS n, d[1] AS dist_min, d[len(d) // 2 + 1] AS dist_median, d[len(d)] AS dist_max,
  least(greatest((d[2] - d[1]) / greatest(d[len(d)] - d[1], 0.000001), 0.0), 1.0) AS sharpness,
  (t + 16)::BIGINT AS stage0_tokens, full_tokens::BIGINT AS full_tokens FROM a, shown"""
)
def stage0_summary(spark, sf_dir):
    return disclosure.summary(pinned(spark, sf_dir), 5)


@query(f"{_PINNED} SELECT rank, sid, dist, tokens FROM pinned WHERE rank % 8 = 0")
def stage0_representatives(spark, sf_dir):
    return disclosure.representatives(pinned(spark, sf_dir), 5).select("rank", "sid", "dist", "tokens")


@query(f"{_PINNED} SELECT rank, sid, dist, tokens FROM pinned")
def drill(spark, sf_dir):
    """Rows pinned at stage 0, read by handle."""
    pins = disclosure.Continuations(spark)
    return pins.drill(pins.pin(pinned(spark, sf_dir))).select("rank", "sid", "dist", "tokens")


@query(f"WITH {LOG} SELECT seq, coalesce(strlen(val), 0) // 4 + 8 AS tokens FROM log")
def token_cost(spark, sf_dir):
    return log_of(spark, sf_dir).select("seq", codecs.grain_tokens(F.octet_length("val")).alias("tokens"))


@query("SELECT unnest(range(905, 5001)) AS handle")
def continuation_evict(spark, sf_dir):
    return disclosure.evict(spark.range(1, 5001).withColumnRenamed("id", "handle"))


# Governance.

_RULES = """rules(rule_id, agent, action, effect, kind, val) AS (VALUES
  (0, 1, 'read', 'allow', 'any', NULL), (1, 1, 'read', 'deny', 'category', 9), (2, 2, 'read', 'allow', 'category', 0),
  (3, 3, 'read', 'mask', 'category', 0), (4, 3, 'read', 'allow', 'category', 1), (5, 4, NULL, 'allow', 'pred', 0), (6, 4, 'write', 'deny', 'category', 5))"""
_DECIDE = """decided AS (
  SELECT r.agent, r.action, r.sid, r.pred, r.category,
    CASE WHEN coalesce(bool_or(u.effect = 'deny'), false) THEN 'deny'
         WHEN r.action = 'read' AND coalesce(bool_or(u.effect = 'mask'), false) THEN 'mask'
         WHEN coalesce(bool_or(u.effect = 'allow'), false) THEN 'allow' ELSE 'deny' END AS decision
  FROM requests r LEFT JOIN rules u ON u.agent = r.agent AND (u.action IS NULL OR u.action = r.action)
    AND (u.kind = 'any' OR (u.kind = 'category' AND u.val = r.category) OR (u.kind = 'pred' AND u.val = r.pred))
  GROUP BY r.agent, r.action, r.sid, r.pred, r.category)"""
_REQUESTS = "requests AS (SELECT a.agent::BIGINT AS agent, t.action, g.sid, g.pred, g.category FROM grains g, (SELECT unnest(range(1, 6)) AS agent) a, (SELECT unnest(['read', 'write']) AS action) t)"


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vecs(spark, sf_dir).select("sid", "pred", "category", F.explode(F.sequence(F.lit(1), F.lit(5)).cast("array<bigint>")).alias("agent"))
    return rows.withColumn("action", F.explode(F.array(F.lit("read"), F.lit("write"))))


@query(f"WITH {VEC}, {_RULES}, {_REQUESTS}, {_DECIDE} SELECT agent, action, sid, decision FROM decided")
def acl_decision(spark, sf_dir):
    return governance.decide(requests(spark, sf_dir), views.rules(spark)).select("agent", "action", "sid", "decision")


@query(f"WITH {VEC} SELECT sid FROM grains WHERE category = 4 AND pred = 0")
def acl_match(spark, sf_dir):
    both = governance.matches("category", 4) & governance.matches("pred", 0) & governance.matches("any", None)
    return vecs(spark, sf_dir).where(both).select("sid")


@query(f"WITH {VEC} SELECT sid, category, CASE WHEN category = 0 THEN '[REDACTED]' ELSE 'sid ' || sid END AS val, CASE WHEN category = 0 THEN 'mask' ELSE 'allow' END AS decision FROM grains WHERE category IN (0, 1)")
def acl_mask(spark, sf_dir):
    rows = vecs(spark, sf_dir).withColumn("val", F.concat(F.lit("sid "), F.col("sid").cast("string")))
    return governance.governed_rows(rows, views.RULE_ROWS, 3).select("sid", "category", "val", "decision")


@query(f"WITH {VEC} SELECT sid, category FROM grains WHERE category != 5")
def acl_write_filter(spark, sf_dir):
    """Writes that agent 4 may commit."""
    rows = vecs(spark, sf_dir)
    return rows.where(governance.decision(views.RULE_ROWS, 4, "write") == "allow").select("sid", "category")


@query(f"WITH {VEC} SELECT sid, CASE WHEN category = 0 THEN 'mask' WHEN category = 1 THEN 'allow' ELSE 'deny' END AS decision, CASE WHEN category IN (0, 1) THEN 72 ELSE 0 END::BIGINT AS tokens FROM grains")
def acl_get(spark, sf_dir):
    """Reads of all facts by agent 3, with what is recorded of each."""
    found = governance.with_cost(mvcc.scan_live(vecs(spark, sf_dir).withColumn("op", F.lit(0))))
    decided = found.withColumn("decision", governance.decision(views.RULE_ROWS, 3, "read"))
    return decided.select("sid", "decision", F.when(F.col("decision") != "deny", F.col("tokens")).otherwise(F.lit(0)).cast("long").alias("tokens"))


@query(f"WITH {DIST}, top AS (SELECT * FROM dists ORDER BY dist, sid LIMIT 20) SELECT sid, dist, category, 72::BIGINT AS tokens FROM top WHERE category != 9")
def acl_query(spark, sf_dir):
    """Top 20, then agent 1's rules; denied rows aren't replaced."""
    rows = knn.nearest(vecs(spark, sf_dir), ask(spark, sf_dir), 20)
    decided = governance.with_cost(rows).where(governance.decision(views.RULE_ROWS, 1, "read") != "deny")
    return decided.select("sid", "dist", "category", "tokens")


@query(
    """WITH RECURSIVE q(agent, seq, cost) AS (VALUES (1, 0, 160), (1, 1, 160), (1, 2, 30), (2, 0, 72), (2, 1, 144), (2, 2, 56), (3, 0, 500)),
f AS (SELECT agent, seq, cost, cost <= 200 AS allowed, CASE WHEN cost <= 200 THEN 200 - cost ELSE 200 END AS remaining FROM q WHERE seq = 0
  UNION ALL SELECT q.agent, q.seq, q.cost, q.cost <= f.remaining, CASE WHEN q.cost <= f.remaining THEN f.remaining - q.cost ELSE f.remaining END FROM q JOIN f ON q.agent = f.agent AND q.seq = f.seq + 1)
SELECT agent::BIGINT AS agent, seq::BIGINT AS seq, cost::BIGINT AS cost, allowed, remaining::BIGINT AS remaining FROM f"""
)
def budget_ledger(spark, sf_dir):
    return governance.budget_ledger(views.query_log(spark), 200)


@query(f"WITH {VEC}, {_RULES}, requests AS (SELECT 3::BIGINT AS agent, 'read' AS action, sid, pred, category FROM grains), {_DECIDE} SELECT sid AS seq, agent, action, sid, pred, decision, CASE WHEN decision = 'deny' THEN 0 ELSE 72 END::BIGINT AS tokens FROM decided")
def audit_log(spark, sf_dir):
    rows = governance.with_cost(vecs(spark, sf_dir))
    decided = rows.drop("seq").withColumns({"agent": F.lit(3).cast("long"), "action": F.lit("read"), "at": F.col("sid"), "decision": governance.decision(views.RULE_ROWS, 3, "read")})
    tokens = F.when(F.col("decision") == "deny", F.lit(0)).otherwise(F.col("tokens")).cast("long")
    return governance.audit_of(decided.withColumn("tokens", tokens))


# Blocks: one per label, so that both engines have the same.

_CENTRES = f"""WITH {VEC}, each AS (SELECT category::BIGINT AS block_id, i AS pos, avg(embedding[i + 1]::DOUBLE) AS m FROM grains, range(0, 64) t(i) GROUP BY ALL),
centres AS (SELECT block_id, list(m ORDER BY pos) AS v FROM each GROUP BY block_id),
radii AS (SELECT q.block_id, q.v, max(sqrt({L2SQ})) AS radius, count(*) AS n, min(seq) AS t_min, max(seq) AS t_max FROM grains g JOIN centres q ON q.block_id = g.category GROUP BY ALL)"""


def by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.assign_by(vecs(spark, sf_dir), "category")


@query(f"{_CENTRES} SELECT block_id, pos::INT AS pos, round(m, 9) AS m FROM each")
def block_centroid(spark, sf_dir):
    return blocks.centroids(by_label(spark, sf_dir)).select("block_id", F.posexplode("centroid").alias("pos", "m")).withColumn("m", F.round("m", 9))


@query(
    f"""{_CENTRES}, sized AS (SELECT *, greatest(64, ceil(-n::DOUBLE * ln(0.01) / (ln(2) * ln(2))))::BIGINT AS bits FROM radii)
SELECT block_id, round(radius, 9) AS radius, '0' AS preds, t_min, t_max, n, bits AS bloom_bits, greatest(1, floor(bits / n::DOUBLE * ln(2) + 0.5))::BIGINT AS bloom_hashes FROM sized"""
)
def block_descriptor(spark, sf_dir):
    out = blocks.descriptors(by_label(spark, sf_dir))
    return out.select("block_id", F.round("radius", 9).alias("radius"), F.array_join(F.col("preds").cast("array<string>"), ",").alias("preds"), "t_min", "t_max", "n", "bloom_bits", "bloom_hashes")


@query(
    f"""WITH {LOG}, b AS (SELECT sid % 8 AS block_id, least(greatest(floor(c::FLOAT::DOUBLE * 8), 0), 7)::INT AS bucket FROM log)
SELECT block_id, bucket, count(*) AS n FROM b GROUP BY ALL"""
)
def block_conf_hist(spark, sf_dir):
    rows = log_of(spark, sf_dir).withColumns({"block_id": F.col("sid") % 8, "c": F.col("c").cast("float")})
    return blocks.confidence_histogram(rows)


@query(f"WITH {LOG} SELECT sid % 8 AS block_id, pred AS category, count(*) AS n FROM log GROUP BY ALL")
def block_cat_counts(spark, sf_dir):
    return blocks.category_counts(log_of(spark, sf_dir).select((F.col("sid") % 8).alias("block_id"), F.col("pred").alias("category")))


@query(f"WITH {LOG} SELECT sid % 8 AS block_id, min(seq) AS t_min, max(seq) AS t_max, count(*) AS n FROM log GROUP BY ALL")
def block_zone_map(spark, sf_dir):
    return blocks.zone_map(log_of(spark, sf_dir).withColumn("block_id", F.col("sid") % 8))


@query(f"WITH {LOG} SELECT count(*) AS n, count(DISTINCT sid % 8) AS blocks_touched, (SELECT count(DISTINCT sid % 8) FROM log) AS blocks_total FROM log WHERE pred = 2")
def block_count_category(spark, sf_dir):
    rows = log_of(spark, sf_dir).select((F.col("sid") % 8).alias("block_id"), F.col("pred").alias("category"))
    return blocks.count_category(blocks.category_counts(rows), 2)


@query()
def block_bloom(spark, sf_dir):
    found = blocks.blooms(by_label(spark, sf_dir))
    return found.select("block_id", "n", F.octet_length("bloom").alias("bytes"), F.sha2("bloom", 256).alias("digest"))


@query()
def bloom_probe(spark, sf_dir):
    """Blocks whose filter may hold each sid that is divisible by 20, and whether they do."""
    rows = by_label(spark, sf_dir)
    maybe = blocks.may_hold(kept(blocks.blooms(rows)), rows.where("sid % 20 = 0"))
    return maybe.join(rows.select("sid", F.col("block_id").alias("own")), "sid").select("sid", "block_id", (F.col("block_id") == F.col("own")).alias("holds"))


@query(f"WITH {VEC} SELECT sid, category, seq FROM grains WHERE sid = 42")
def block_get(spark, sf_dir):
    rows = kept(by_label(spark, sf_dir))
    return blocks.get(rows, kept(blocks.blooms(rows)), 42)[0].select("sid", "category", "seq")


@query(f"WITH {DIST} SELECT sid, round(sqrt(dist), 12) AS dist FROM dists ORDER BY dists.dist, sid LIMIT 10")
def block_near(spark, sf_dir):
    rows = by_label(spark, sf_dir)
    found, _ = blocks.near(rows, kept(blocks.descriptors(rows)), ask(spark, sf_dir), K)
    return found.select("sid", F.round("dist", 12).alias("dist"))


def laid_out(spark: SparkSession, sf_dir: str) -> blocks.Stored:
    """One block per label, written as folders."""
    path = shared_path(spark, "blocks")
    blocks.write(by_label(spark, sf_dir), path)
    return blocks.Stored(spark, path)


@query(f"WITH {DIST} SELECT sid, round(sqrt(dist), 12) AS dist FROM dists ORDER BY dists.dist, sid LIMIT 10")
def block_near_stored(spark, sf_dir):
    """The ten nearest from blocks on disk; blocks that can't hold one aren't opened."""
    found, _ = laid_out(spark, sf_dir).near(ask(spark, sf_dir), K)
    return found.select("sid", F.round("dist", 12).alias("dist"))


@query(f"WITH {VEC} SELECT sid, category, seq FROM grains WHERE sid = 42")
def block_get_stored(spark, sf_dir):
    """One fact from blocks on disk, of which those are opened whose Bloom filter may hold it."""
    return laid_out(spark, sf_dir).get(42)[0].select("sid", "category", "seq")


@query()
def block_stats(spark, sf_dir):
    """Blocks that each query whose id is divisible by 20 reads, among as many generated vectors near
    latent centres as there are embeddings, which have no clusters."""
    rows = kept(blocks.assign_kmeans(views.grains_clustered(spark, vecs(spark, sf_dir).count()), 64))
    asked = rows.where(F.col("sid") % 20 == 0).select(F.col("sid").alias("query_id"), F.col("embedding").alias("vector"))
    return blocks.touched(kept(blocks.descriptors(rows)), asked, K)


@query(f"WITH {VEC} SELECT count(DISTINCT category) AS blocks FROM grains")
def block_count(spark, sf_dir):
    return blocks.zone_map(by_label(spark, sf_dir)).agg(F.count("*").alias("blocks"))


@query()
def kmeans_blocks(spark, sf_dir):
    return blocks.assign_kmeans(vecs(spark, sf_dir), 16).groupBy("block_id").agg(F.count("*").alias("n"))


@query(f"{_CENTRES}, q0 AS (SELECT embedding AS w FROM embeddings WHERE vec_id = 0) SELECT g.block_id, round(greatest(sqrt({L2SQ.replace('g.embedding', 'g.v').replace('q.v', 'q.w')}) - radius, 0), 9) AS low FROM radii g, q0 q")
def block_lower_bound(spark, sf_dir):
    described = blocks.descriptors(by_label(spark, sf_dir))
    low = blocks.lower_bound(F.col("centroid"), F.col("radius"), ask(spark, sf_dir))
    return described.select("block_id", F.round(low, 9).alias("low"))


@query(f"WITH {LOG} SELECT sid AS block_id, bool_or(pred = 3) AS has_pred, count(*) FILTER (pred = 3) AS n FROM log GROUP BY ALL")
def block_has_pred(spark, sf_dir):
    """Whether each sid's block has an attribute, and how often."""
    rows = log_of(spark, sf_dir).withColumn("block_id", F.col("sid"))
    held = rows.groupBy("block_id").agg(F.sort_array(F.collect_set("pred")).alias("preds"), F.count(F.when(F.col("pred") == 3, 1)).alias("n"))
    return held.select("block_id", F.array_contains("preds", 3).alias("has_pred"), "n")


# Scalar functions and codecs.


@query(
    """WITH b AS (SELECT event_id, list_transform(range(1, length(props) + 1), lambda i: ascii(substr(props, i, 1))::UHUGEINT) AS codes FROM events)
SELECT event_id, lpad(lower(to_hex(list_reduce(codes, lambda h, x: (xor(h, x) * 1099511628211::UHUGEINT) % 18446744073709551616::UHUGEINT, 14695981039346656037::UHUGEINT)::UBIGINT)), 16, '0') AS fnv FROM b"""
)
def fnv1a(spark, sf_dir):
    return views.read(spark, sf_dir, "events").select("event_id", hashing.fnv1a(F.col("props")).alias("fnv"))


@query()
def crc32(spark, sf_dir):
    return log_of(spark, sf_dir).select("seq", hashing.crc32(F.col("val")).alias("crc"))


@query(
    """WITH m AS (SELECT vec_id AS sid, (xor(vec_id, vec_id >> 33)::UHUGEINT * 18397679294719823053::UHUGEINT) % 18446744073709551616::UHUGEINT AS x FROM embeddings)
SELECT sid, (xor(x::UBIGINT, x::UBIGINT >> 33) % 8)::BIGINT AS shard FROM m"""
)
def shard_route(spark, sf_dir):
    return vecs(spark, sf_dir).select("sid", hashing.shard_of(F.col("sid"), 8).alias("shard"))


#: Numbers of each text's embedding in SQL: hashes of its byte n-grams, added up by place with their sign.
_EMBED = """bytes AS (SELECT id, regexp_extract_all(hex(encode(text)), '..') AS b FROM texts WHERE length(text) > 0),
runs AS (SELECT id, unnest(b) AS x, unnest(list_concat(b[2:], [NULL])) AS y, unnest(list_concat(b[3:], [NULL, NULL])[:len(b)]) AS z FROM bytes),
counted AS (
  SELECT id, x AS gram, count(*) AS n FROM runs GROUP BY ALL UNION ALL SELECT id, x || y, count(*) FROM runs WHERE y IS NOT NULL GROUP BY ALL
  UNION ALL SELECT id, x || y || z, count(*) FROM runs WHERE z IS NOT NULL GROUP BY ALL
), grams AS (
  SELECT gram, list_transform(regexp_extract_all(gram, '..'), lambda c: ('0x' || c)::UTINYINT::UHUGEINT) AS codes FROM (SELECT DISTINCT gram FROM counted)
), hashes AS (
  SELECT gram, list_reduce(codes, lambda h, c: (xor(h, c) * 1099511628211::UHUGEINT) % 18446744073709551616::UHUGEINT, 14695981039346656037::UHUGEINT) AS h FROM grams
), places AS (SELECT id, (h % 64)::INT AS pos, sum(CASE WHEN h >= 9223372036854775808::UHUGEINT THEN -n ELSE n END)::DOUBLE AS x FROM counted JOIN hashes USING (gram) GROUP BY ALL),
norms AS (SELECT id, greatest(sqrt(sum(x * x)), 0.000001) AS norm FROM places GROUP BY id)"""


@query(f"""WITH texts AS (SELECT doc_id AS id, text FROM documents), {_EMBED}
SELECT p.id AS doc_id, pos, (x / norm)::FLOAT::DOUBLE AS x FROM places p JOIN norms n USING (id) WHERE x != 0""")
def embed_text_documents(spark, sf_dir):
    """The numbers other than 0 of each document's embedding."""
    made = views.read(spark, sf_dir, "documents").select("doc_id", embed_text(F.col("text")).alias("embedding"))
    return made.select("doc_id", F.posexplode("embedding").alias("pos", "x")).where("x != 0").withColumn("x", F.col("x").cast("double"))


QUERIES["embed_text"], ORACLES["embed_text"] = QUERIES.pop("embed_text_documents"), ORACLES.pop("embed_text_documents")
ORACLES["store_query_text"] = _text_twin()


@query(
    """WITH n AS (SELECT unnest([1, 2, 10, 100, 1000, 123456])::BIGINT AS n), b AS (SELECT n, greatest(64, ceil(-n::DOUBLE * ln(0.01) / (ln(2) * ln(2))))::BIGINT AS bits FROM n)
SELECT n, bits, greatest(1, floor(bits / n::DOUBLE * ln(2) + 0.5))::BIGINT AS hashes FROM b"""
)
def bloom_params(spark, sf_dir):
    rows = spark.createDataFrame([(n,) for n in (1, 2, 10, 100, 1000, 123456)], "n bigint")
    bits, hashes = hashing.bloom_params(F.col("n"))
    return rows.select("n", bits.alias("bits"), hashes.alias("hashes"))


@query(
    f"""WITH {LOG} SELECT seq, printf('%016x%016x%08x', 0, sid, pred) || lower(to_hex(18446744073709551615::UBIGINT - seq::UBIGINT)) AS key, seq AS back FROM log"""
)
def key_codec(spark, sf_dir):
    rows = log_of(spark, sf_dir).withColumn("k", codecs.grain_key(F.col("sid"), F.col("pred"), F.col("seq")))
    return rows.select("seq", F.lower(F.hex("k")).alias("key"), codecs.seq_of_key(F.col("k")).alias("back"))


@query("SELECT doc_id, list_position(['de', 'en', 'es', 'fr'], lang)::INT - 1 AS category, -n_chars AS amount, text FROM documents")
def value_codec(spark, sf_dir):
    rows = views.grains_text(spark, sf_dir)
    value = codecs.encode_store_value(F.col("category"), -F.col("amount"), F.col("text"))
    return rows.select(F.col("sid").alias("doc_id"), codecs.decode_store_value(value).alias("v")).select("doc_id", "v.*")


@query(f"WITH {LOG} SELECT seq, op::INT AS op, c::FLOAT::DOUBLE AS c, t_valid, coalesce(val, '') AS val, 13 + strlen(coalesce(val, '')) AS size FROM log")
def kv_value_codec(spark, sf_dir):
    """Stored values of the log, packed and read back."""
    rows = log_of(spark, sf_dir)
    packed = codecs.encode_value(F.col("op"), F.col("c").cast("float"), F.col("t_valid"), F.encode("val", "UTF-8"))
    back = rows.select("seq", packed.alias("p")).select("seq", F.octet_length("p").cast("long").alias("size"), codecs.decode_value(F.col("p")).alias("v"))
    return back.select("seq", "v.op", F.col("v.c").cast("double").alias("c"), "v.t_valid", F.decode("v.val", "UTF-8").alias("val"), "size")


@query("SELECT vec_id AS sid, 257 AS size, true AS same FROM embeddings")
def vector_codec(spark, sf_dir):
    rows = vecs(spark, sf_dir).withColumn("val", codecs.encode_vector(codecs.big_endian(F.col("category"), 1), F.col("embedding")))
    back = codecs.decode_vector(F.col("val"), 1, DIM)
    return rows.select("sid", F.octet_length("val").alias("size"), (back == F.col("embedding")).alias("same"))
