"""The log: an append-only Parquet folder with a commit record for each batch.

A batch is first written under ``rows/batch_id=N``, N drawn at random, and then recorded by one
file under ``commits``, named by the next version. That file is made in one step and never replaced,
so of two writers that want a version one gets it, and the other numbers its rows anew. Readers and
streams see recorded batches only; a batch whose writer was lost before its record doesn't exist.

Writers of one process that come together are committed as a group: the first to get the log's
lock commits all that wait, as one batch.
"""

from __future__ import annotations

import json
import threading
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..errors import Closed
from ..operators import idempotency, sequence
from ..storage import kept
from .files import Files

#: One commit: its version from 0, the folder of its rows, the tags it was sent under, rows, first
#: and last sequence, least and greatest key.
RECORD = "version bigint, batch_id bigint, tags array<string>, n bigint, low bigint, high bigint, key_low bigint, key_high bigint"


@dataclass
class Pending:
    """A batch that waits to be committed, and what became of it."""

    batch: DataFrame
    tag: str | None
    version: int | None = None
    error: Exception | None = None

    @property
    def done(self) -> bool:
        return self.version is not None or self.error is not None


@dataclass
class Committer:
    """What the writers of one process share for one log."""

    lock: threading.Lock = field(default_factory=threading.Lock)
    gate: threading.Lock = field(default_factory=threading.Lock)
    waiting: list[Pending] = field(default_factory=list)


COMMITTERS: dict[str, Committer] = {}
MAKING = threading.Lock()


def committer_of(path: str) -> Committer:
    with MAKING:
        return COMMITTERS.setdefault(path, Committer())


class FactLog:
    """Log of writes with columns sid, pred, op, idem_key and any others, and seq."""

    def __init__(self, spark: SparkSession, path: str, schema: str):
        """``schema`` is the columns of the rows, seq among them."""
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema
        self.files, self.committer, self.open = Files(spark), committer_of(path.rstrip("/")), True
        self.last: dict | None = None  # the newest record that is known

    # Reading

    def commits(self) -> DataFrame:
        if not self.files.exists(f"{self.path}/commits"):
            return self.spark.createDataFrame([], RECORD)
        return self.spark.read.schema(RECORD).json(f"{self.path}/commits")

    def rows_of(self, records: DataFrame) -> DataFrame:
        """Rows of the recorded batches in ``records``, with batch_id. A semi-join: its small side
        has a row per commit."""
        if not self.files.exists(f"{self.path}/rows"):
            return self.spark.createDataFrame([], f"{self.schema}, batch_id bigint")
        rows = self.spark.read.schema(f"{self.schema}, batch_id bigint").parquet(f"{self.path}/rows")
        return rows.join(records.select("batch_id"), "batch_id", "left_semi").select(*rows.columns)

    def read(self) -> DataFrame:
        """All rows of recorded batches."""
        return self.rows_of(self.commits())

    def newest(self) -> dict:
        """The newest record; version -1 and high 0 for an empty log. Read from the newest known on."""
        if self.last is None:
            row = self.commits().agg(F.max_by(F.struct("*"), "version").alias("r")).first()["r"]
            self.last = {"version": -1, "high": 0} if row is None else row.asDict()
        while (text := self.files.read(self._name(self.last["version"] + 1))) is not None:
            self.last = json.loads(text)
        return self.last

    def _name(self, version: int) -> str:
        return f"{self.path}/commits/{version:012d}.json"

    def is_healthy(self) -> bool:
        """Whether the log takes writes."""
        return self.open

    def close(self) -> None:
        """Ends writing through this object, after what waits; the log can be opened anew."""
        with self.committer.lock:
            self.open = False

    # Writing

    def stage(self, batch: DataFrame, after: int | None = None) -> dict:
        """Writes the first arrivals of new keys, numbered from ``after`` (the log's last sequence)
        on, and returns their record, which isn't part of the log yet."""
        newest = self.newest()
        after = newest["high"] if after is None else after
        firsts = idempotency.first_arrivals(batch)
        if newest["version"] >= 0:
            firsts = kept(firsts)
            least, most = firsts.agg(F.min("idem_key"), F.max("idem_key")).first()
            met = self.commits().where((F.col("key_high") >= least) & (F.col("key_low") <= most)) if least is not None else None
            if met is not None:  # batches whose keys lie elsewhere aren't read, nor row groups
                firsts = idempotency.unseen(firsts, self.rows_of(met).where(F.col("idem_key").between(least, most)))
        numbered = sequence.number(firsts, ["arrival"], start=after + 1)
        columns = self.spark.createDataFrame([], self.schema).columns
        batch_id = uuid.uuid4().int >> 65
        place = f"{self.path}/rows/batch_id={batch_id}"
        numbered.select(*columns).write.parquet(place)
        keys = [F.min("idem_key").alias("key_low"), F.max("idem_key").alias("key_high")]
        facts = self.spark.read.schema(self.schema).parquet(place).agg(F.count("*").alias("n"), *keys).first().asDict()
        return facts | {"batch_id": batch_id, "tags": [], "low": after + 1, "high": after + facts["n"]}

    def record(self, staged: dict, version: int) -> bool:
        """Makes a staged batch part of the log under a version; False if the version is taken."""
        self.files.make(f"{self.path}/commits")
        made = staged | {"version": version}
        if not self.files.write(self._name(version), json.dumps(made) + "\n"):
            return False
        self.last = made
        return True

    def commit(self, batch: DataFrame, tag: str | int | None = None) -> int:
        """Stages and records a batch (arrival orders it); returns the version that has it.

        A batch under a tag that is recorded changes nothing, so one that is sent again after a
        failure counts once. Safe from any number of threads and processes: rows of one process
        that wait together become one batch, in the order in which they came.
        """
        if not self.open:
            raise Closed("the log was closed")
        pending = Pending(batch, None if tag is None else str(tag))
        with self.committer.gate:
            self.committer.waiting.append(pending)
        with self.committer.lock:
            if not pending.done:
                with self.committer.gate:
                    group, self.committer.waiting = self.committer.waiting, []
                self._commit_group(group)
        if pending.error is not None:
            raise pending.error
        return pending.version

    def _commit_group(self, group: list[Pending]) -> None:
        try:
            self._commit_all(group)
        except Exception as error:
            if len(group) == 1:
                group[0].error = error
                return
            for one in group:  # one that fails doesn't take the others with it
                if not one.done:
                    self._commit_group([one])

    def _commit_all(self, group: list[Pending]) -> None:
        tags = [p.tag for p in group if p.tag is not None]
        known = {}
        if tags and self.newest()["version"] >= 0:
            sent = self.commits().select("version", F.explode("tags").alias("tag")).where(F.col("tag").isin(tags))
            known = {r["tag"]: r["version"] for r in sent.collect()}
        for p in group:
            p.version = known.get(p.tag)
        new = {p.tag if p.tag is not None else id(p): p for p in group if p.version is None}  # a tag once
        while new:
            newest = self.newest()
            parts = [p.batch for p in new.values()]
            if len(parts) > 1:
                parts = [b.withColumn("arrival", F.struct(F.lit(i).alias("turn"), F.col("arrival").cast("long").alias("at"))) for i, b in enumerate(parts)]
            staged = self.stage(reduce(DataFrame.unionByName, parts), newest["high"])
            staged["tags"] = [p.tag for p in new.values() if p.tag is not None]
            version = newest["version"] + 1
            if self.record(staged, version):
                for p in group:
                    p.version = version if p.version is None else p.version
                return
            self.files.delete(f"{self.path}/rows/batch_id={staged['batch_id']}")  # another process was first

    def acknowledge(self, batch: DataFrame) -> DataFrame:
        """The batch's rows with the sequence of their key's first write."""
        return idempotency.acknowledged(batch, self.read())

    # Following

    def follow(self, into: Callable[[DataFrame, int], None], checkpoint: str, from_now: bool = False) -> StreamingQuery:
        """Runs ``into(records, batch_id)`` over all commits there are, then stops; ``rows_of`` gives
        their rows. A stream of commit records, so rows that were staged only don't reach it.

        Each call with the same checkpoint goes on where the last one ended; several followers are
        independent. One that is opened with ``from_now`` sees what is committed after that.
        """
        self.files.make(f"{self.path}/commits")
        if from_now:
            self.files.make(checkpoint)
            self.files.write(f"{checkpoint}/since", str(self.newest()["version"]))  # of the first call
        since = int(self.files.read(f"{checkpoint}/since") or -1)

        def run(records: DataFrame, batch_id: int) -> None:
            into(records.where(F.col("version") > since), batch_id)

        stream = self.spark.readStream.schema(RECORD).json(f"{self.path}/commits")
        return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
