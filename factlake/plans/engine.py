"""The engine: writes to the log, and queries on what is derived from it.

Derived state is a function of the log at one snapshot, so a query sees one snapshot throughout
and an engine opened on an old log needs no rebuild.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import Denied
from ..functions import codecs
from ..operators import catalog, disclosure, governance, knn, mvcc, near
from ..schema import ALLOW, DELETE, DENY, PUT, READ, REMOVE, WRITE
from ..sources.log import FactLog
from ..storage import kept, shared_path
from ..streaming import changes
from . import planner
from .indexes import Index

VECTORS = "seq bigint, sid bigint, pred bigint, op smallint, category int, embedding array<float>, c float, t_valid bigint, idem_key bigint, val_bytes bigint"


@dataclass(frozen=True)
class WriteMeta:
    """Confidence and valid time of a write; the valid time is stored and never filters."""

    c: float = 1.0
    t_valid: int = 0


@dataclass(frozen=True)
class Config:
    """Length of vectors, bytes before the vector in a raw value, and parts of the derived state."""

    dim: int
    header: int = 0
    workers: int = changes.BUCKETS


class Engine:
    """Facts with vectors of one length.

    ``mode`` is "exact" (filter, then measure), or "postfilter" (planned candidates by exact
    distance); with an ``index`` candidates come from it instead, as of its last ``rebuild`` or
    ``sync``, and are joined with the current facts.
    """

    def __init__(self, spark: SparkSession, path: str, dim: int, mode: str = "exact"):
        self.spark, self.mode = spark, mode
        self.config, self.index = Config(dim), None
        self.embedder: Callable[[Column], Column] = lambda value: codecs.decode_vector(value, self.config.header, self.dim)
        self.log = FactLog(spark, path, VECTORS)
        self.continuations = disclosure.Continuations(spark)
        self.indexed = 0

    @classmethod
    def open_with(cls, spark: SparkSession, path: str, config: Config, index: Index | None = None, embedder: Callable[[Column], Column] | None = None) -> Engine:
        """An engine with an index or embedder of the caller's; an embedder turns a column of values
        into a column of vectors, null where a value has none."""
        out = cls(spark, path, config.dim)
        out.config, out.index = config, index
        if embedder is not None:
            out.embedder = embedder
        return out

    @property
    def dim(self) -> int:
        return self.config.dim

    def truth(self) -> DataFrame:
        """All versions, for reads of any kind."""
        return self.log.read()

    def is_healthy(self) -> bool:
        return self.log.is_healthy()

    def put_vectors(self, rows: DataFrame, meta: WriteMeta = WriteMeta()) -> int:
        """Commits rows (arrival, sid, pred, category, embedding, idem_key); returns the version."""
        return self._put(rows.withColumn("val_bytes", (1 + 4 * F.size("embedding")).cast("long")), meta)

    def put_raw(self, rows: DataFrame, meta: WriteMeta = WriteMeta()) -> int:
        """Commits rows (arrival, sid, pred, value, idem_key) whose vectors the embedder makes; a
        value without one is a fact that no search finds. Such facts have no category, so they
        count in no category's statistics."""
        made = rows.withColumns({"embedding": self.embedder(F.col("value")), "category": F.lit(None).cast("int"), "val_bytes": F.octet_length("value").cast("long")})
        return self._put(made.drop("value"), meta)

    def _put(self, rows: DataFrame, meta: WriteMeta) -> int:
        kinds = {"op": F.lit(PUT).cast("smallint"), "c": F.lit(meta.c).cast("float"), "t_valid": F.lit(meta.t_valid).cast("long")}
        return self.log.commit(rows.withColumns(kinds))

    def delete(self, rows: DataFrame) -> int:
        """Commits tombstones for rows (arrival, sid, pred, idem_key)."""
        kinds = {"op": F.lit(DELETE).cast("smallint"), "category": F.lit(None).cast("int"), "embedding": F.lit(None).cast("array<float>")}
        more = {"c": F.lit(1.0).cast("float"), "t_valid": F.lit(0).cast("long"), "val_bytes": F.lit(0).cast("long")}
        return self.log.commit(rows.withColumns(kinds | more))

    def current(self, snapshot: int | None = None) -> DataFrame:
        return mvcc.scan_live(self.log.read(), snapshot)

    def get(self, sid: int, pred: int, snapshot: int | None = None) -> DataFrame:
        return mvcc.get_at(self.log.read(), sid, pred, snapshot)

    def index_len(self) -> int:
        return knn.psi(self.log.read(), self.dim).count()

    def rebuild(self) -> int:
        """Builds the index from the log as it is; returns how many vectors it has."""
        high = self.log.newest()["high"]
        if self.index is None:
            self.indexed = high
            return self.index_len()
        self.index.build(knn.psi(self.log.read(), self.dim, high), self.dim)
        self.indexed = high
        return self.index.size()

    def sync(self, seq: int, timeout: float) -> bool:
        """Whether queries see a sequence within so many seconds; the index is rebuilt if it is behind."""
        until = time.monotonic() + timeout
        while self.log.newest()["high"] < seq:
            if time.monotonic() > until:
                return False
            time.sleep(0.05)
        if self.index is not None and self.indexed < seq:
            self.rebuild()
        return True

    def query(self, pred: int, vector: Sequence[float], k: int, where: Column | None = None, over_fetch: int = 1, ef: int = 128) -> DataFrame:
        facts = self.current()
        if self.index is not None:
            if not self.indexed:
                self.rebuild()
            fetched = max(k * max(over_fetch, 1), k)
            found = kept(self.index.search(vector, fetched, max(ef, fetched)))
            return near.with_values(found, facts.where(F.col("pred") == pred), k, where if where is not None else near.filter_any(), fetched)
        if self.mode == "exact":
            return near.near_select(facts, vector, k, where, pred)
        return near.near_select_postfilter(facts, facts, vector, k, over_fetch, where if where is not None else near.filter_any(), pred)

    def query_planned(self, pred: int, vector: Sequence[float], k: int, target: float, category: int | None = None) -> tuple[DataFrame, planner.Plan]:
        """Rows and the plan made for the filter's selectivity (1 without a filter, 0.5 if unknown)."""
        facts, sel = self.current(), 1.0
        where = near.filter_any() if category is None else F.col("category") == category
        if category is not None:
            known = catalog.selectivity(facts, category).first()["selectivity"]
            sel = planner.UNKNOWN_SELECTIVITY if known is None else known
        made = planner.plan(sel, k, target)
        return self.query(pred, vector, k, where, made.over_fetch, made.ef), made

    def query_staged(self, pred: int, vector: Sequence[float], k: int, target: float, reps: int, category: int | None = None):
        """(summary, representatives, handle): stage 0 of a planned query, its rows pinned."""
        rows, _ = self.query_planned(pred, vector, k, target, category)
        handle = self.continuations.pin(disclosure.ranked(rows))
        pinned = self.continuations.drill(handle)
        return disclosure.summary(pinned, reps), disclosure.representatives(pinned, reps), handle

    def drill(self, handle: int) -> DataFrame | None:
        return self.continuations.drill(handle)


AUDIT = "at bigint, turn bigint, agent bigint, action string, sid bigint, pred bigint, decision string, tokens bigint"


class Governed:
    """An engine behind rules, token budgets and an audit trail.

    The trail is a Parquet folder, one part per operation, written by the executors; what remains
    of each agent's budget is a small file, replaced in one step. Both are at ``path``, so a restart
    goes on with them. One process spends a budget at a time.
    """

    def __init__(self, engine: Engine, rules: Sequence[governance.Rule], budget: int, path: str | None = None):
        self.engine, self.rules, self.default = engine, list(rules), budget
        self.path = path or shared_path(engine.spark, "governed")
        self.files = engine.log.files
        self.files.make(self.path)
        state = json.loads(self.files.read(f"{self.path}/state.json") or "{}")
        self.remaining: dict[int, int] = {int(a): n for a, n in state.get("remaining", {}).items()}
        self.turn: int = state.get("turn", 0)

    def _save(self) -> None:
        self.files.write(f"{self.path}/state.json", json.dumps({"remaining": self.remaining, "turn": self.turn}), replace=True)

    def record(self, rows: DataFrame) -> None:
        """Adds rows (at, agent, action, sid, pred, decision, tokens) to the trail; ``at`` orders
        them within their operation."""
        self.turn += 1
        self._save()
        columns = [F.col("at").cast("long"), F.lit(self.turn).cast("long").alias("turn"), *[F.col(c).cast(t) for c, t in (x.split() for x in AUDIT.split(", ")[2:])]]
        rows.select(*columns).write.mode("append").parquet(f"{self.path}/audit")

    def audit(self, agent: int, action: str, sid: int, pred: int, decision: str, tokens: int) -> None:
        self.record(self.engine.spark.createDataFrame([(0, agent, action, sid, pred, decision, tokens)], "at bigint, agent bigint, action string, sid bigint, pred bigint, decision string, tokens bigint"))

    def trail(self) -> DataFrame:
        """The audit numbers, from 0, and rows, in the order of operations."""
        if not self.files.exists(f"{self.path}/audit"):
            return governance.audit_of(self.engine.spark.createDataFrame([], AUDIT))
        rows = self.engine.spark.read.schema(AUDIT).parquet(f"{self.path}/audit")
        return governance.audit_of(rows.withColumn("at", F.struct("turn", "at")))

    def spend(self, agent: int, cost: int) -> bool:
        """Debits the cost if that much remains; else leaves the budget."""
        left = self.remaining.setdefault(agent, self.default)
        if left < cost:
            return False
        self.remaining[agent] = left - cost
        self._save()
        return True

    def put_vectors(self, agent: int, rows: DataFrame) -> int:
        """Commits the rows that the agent may write; each is audited. Returns how many were denied."""
        return self._commit(agent, WRITE, rows, self.engine.put_vectors)

    def delete(self, agent: int, rows: DataFrame) -> int:
        """Deletes the facts (arrival, sid, pred, idem_key) that the agent may, by their current category."""
        known = self.engine.current().select("sid", "pred", "category")
        return self._commit(agent, REMOVE, rows.join(known, ["sid", "pred"], "left"), lambda allowed: self.engine.delete(allowed.drop("category")))

    def must_put(self, agent: int, rows: DataFrame) -> int:
        """``put_vectors`` of rows that the agent may write all of; Denied, and nothing written, if not."""
        if not rows.where(governance.decision(self.rules, agent, WRITE) != ALLOW).isEmpty():
            raise Denied(f"agent {agent} may not write all of the rows")
        return self.put_vectors(agent, rows)

    def _commit(self, agent: int, action: str, rows: DataFrame, into: Callable[[DataFrame], int]) -> int:
        decided = kept(rows.withColumn("decision", governance.decision(self.rules, agent, action)))
        who = {"at": F.col("arrival"), "agent": F.lit(agent), "action": F.lit(action), "tokens": F.lit(0)}
        self.record(decided.withColumns(who))
        into(decided.where(F.col("decision") == ALLOW).drop("decision"))
        return decided.where(F.col("decision") != ALLOW).count()

    def get(self, agent: int, sid: int, pred: int):
        """The row, redacted or None. Tokens are recorded, not debited; a missing fact isn't audited."""
        rows = governance.with_cost(self.engine.get(sid, pred)).withColumn("decision", governance.decision(self.rules, agent, READ))
        row = rows.withColumn("masked", F.col("decision") == "mask").first()
        if row is None:
            return None
        self.audit(agent, READ, sid, pred, row["decision"], row["tokens"] if row["decision"] != "deny" else 0)
        return None if row["decision"] == "deny" else row

    def query_planned(self, agent: int, pred: int, vector: Sequence[float], k: int, target: float, category: int | None = None) -> list | None:
        """Rows the agent may read (denied ones aren't replaced), or None if the budget can't bear
        them. One audit row, with sid 0."""
        rows, _ = self.engine.query_planned(pred, vector, k, target, category)
        decided = governance.with_cost(rows).withColumn("decision", governance.decision(self.rules, agent, READ))
        out = decided.where(F.col("decision") != "deny").orderBy("dist", "sid").collect()
        cost = sum(r["tokens"] for r in out)
        fits = self.spend(agent, cost)
        self.audit(agent, READ, 0, pred, "allow" if fits else "deny", cost)
        return out if fits else None

    def query_staged(self, agent: int, pred: int, vector: Sequence[float], k: int, target: float, reps: int, category: int | None = None):
        """(summary, representatives, handle) of the rows the agent may read, pinned as the agent
        sees them; None if the budget can't bear the whole result."""
        rows, _ = self.engine.query_planned(pred, vector, k, target, category)
        decided = rows.withColumn("decision", governance.decision(self.rules, agent, READ))
        pinned = disclosure.ranked(decided.where(F.col("decision") != DENY))
        handle = self.engine.continuations.pin(pinned)
        pinned = self.engine.drill(handle)
        summary = disclosure.summary(pinned, reps)
        cost = summary.first()["full_tokens"]
        fits = self.spend(agent, cost)
        self.audit(agent, READ, 0, pred, ALLOW if fits else DENY, cost)
        return (summary, disclosure.representatives(pinned, reps), handle) if fits else None
