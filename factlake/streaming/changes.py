"""The change feed, derived state kept by it, and a stateful sequence."""

from __future__ import annotations

import json
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import knn, mvcc
from ..sources.log import FactLog
from ..storage import shared_path

#: What the feed carries of a write.
FEED = ("sid", "pred", "seq", "op", "val")

#: Parts of a materialised state, by key; a batch rewrites the parts that it has keys of.
BUCKETS = 64


def feed(log: DataFrame) -> DataFrame:
    """Changes of a log, batch or stream: key, sequence, kind and value, no confidence or times."""
    return log.select(*FEED)


def subscribe(log: FactLog, into: Callable[[DataFrame], None], checkpoint: str, from_now: bool = False) -> StreamingQuery:
    """Runs ``into(changes)`` over the committed rows that this checkpoint has not seen, then stops.
    With ``from_now`` the first call sees nothing and marks where later ones begin."""
    return log.follow(lambda records, _: into(feed(log.rows_of(records))), checkpoint, from_now)


def follow(rows: DataFrame, into: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Runs ``into(batch, batch_id)`` over all rows there are of a stream, then stops."""
    return rows.writeStream.foreachBatch(into).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class Materializer:
    """Keeps the newest version of each (sid, pred) of a log in Parquet, commit by commit.

    The state is cut into buckets by key. A batch of commits is merged, by sequence, into the buckets
    it has keys of; these are written anew, then one file, replaced in one step, names the folder of
    each bucket and the last commit applied, and then the old folders go. So a batch that was lost
    half way is done again, one that was applied is skipped, and a restart goes on at ``path``.
    """

    def __init__(self, log: FactLog, dim: int, path: str | None = None, buckets: int = BUCKETS):
        self.log, self.dim, self.spark, self.buckets = log, dim, log.spark, buckets
        self.path = path or shared_path(self.spark, "materializer")
        self.running: StreamingQuery | None = None
        log.files.make(self.path)

    def pointer(self) -> dict:
        text = self.log.files.read(f"{self.path}/current.json")
        return json.loads(text) if text else {"version": -1, "high": 0, "folders": {}}

    def _read(self, folders: list[str]) -> DataFrame:
        places = [f"{self.path}/{f}" for f in folders]
        return self.spark.read.schema(self.log.schema).parquet(*places) if places else self.spark.createDataFrame([], self.log.schema)

    def state(self) -> DataFrame:
        return self._read(list(self.pointer()["folders"].values()))

    def merge(self, records: DataFrame, batch_id: int = 0) -> None:
        """Applies the commits in ``records``."""
        was = self.pointer()
        last = records.agg(F.max("version").alias("version"), F.max("high").alias("high")).first()
        if last["version"] is None or last["version"] <= was["version"]:
            return
        bucket = F.pmod(F.xxhash64("sid", "pred"), F.lit(self.buckets)).alias("bucket")
        rows = mvcc.newest(self.log.rows_of(records.where(F.col("version") > was["version"])).drop("batch_id"))
        touched = [str(r["bucket"]) for r in rows.select(bucket).distinct().collect()]  # ``buckets`` at most
        merged = mvcc.newest(self._read([was["folders"][b] for b in touched if b in was["folders"]]).unionByName(rows))
        made = f"upto={last['version']}"
        merged.select("*", bucket).repartition("bucket").write.partitionBy("bucket").mode("overwrite").parquet(f"{self.path}/{made}")
        folders = was["folders"] | {b: f"{made}/bucket={b}" for b in touched}
        self.log.files.write(f"{self.path}/current.json", json.dumps({"version": last["version"], "high": last["high"], "folders": folders}), replace=True)
        for b in touched:
            if b in was["folders"]:
                self.log.files.delete(f"{self.path}/{was['folders'][b]}")

    def watermark(self) -> int:
        """The last sequence that the state has, with all before it: commits are applied in order
        and their sequences leave no gap."""
        return self.pointer()["high"]

    def sync(self) -> int:
        """Applies all that is in the log; returns the watermark."""
        self.running = self.log.follow(self.merge, f"{self.path}/checkpoint")
        self.running.awaitTermination()
        return self.watermark()

    def wait_for(self, seq: int, timeout: float) -> bool:
        """Whether the state reached a sequence within so many seconds."""
        until = time.monotonic() + timeout
        while self.watermark() < seq:
            if time.monotonic() > until:
                return False
            if self.log.newest()["high"] > self.watermark():
                self.sync()
            else:
                time.sleep(0.05)
        return True

    def is_healthy(self) -> bool:
        """Whether the last run ended without failure, or none has been."""
        return self.running is None or self.running.exception() is None

    def psi(self) -> DataFrame:
        state = self.state()
        return state.where((F.col("op") == 0) & (F.size("embedding") == self.dim))

    def in_step(self) -> bool:
        """Whether the state equals what a batch read of the log gives."""
        want = knn.psi(self.log.read(), self.dim).select("sid", "pred", "seq")
        have = self.psi().select("sid", "pred", "seq")
        return want.exceptAll(have).isEmpty() and have.exceptAll(want).isEmpty()


def group_commit(log: FactLog, writes: DataFrame, checkpoint: str) -> StreamingQuery:
    """Commits a stream of writes, a micro-batch as one group, once each whatever is repeated. The
    tag of a micro-batch names the checkpoint, so streams and other writers don't meet."""
    return follow(writes, lambda batch, batch_id: log.commit(batch, f"{checkpoint}#{batch_id}") and None, checkpoint)


def numbered_stream(spark: SparkSession, writes: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """(idem_key, seq, fresh) for a stream of keys: a state per key group remembers given numbers.

    One key group holds the whole sequence, as the order is total: its state grows with the keys.
    Batches use ``sequence.number`` instead, which is spread over partitions.
    """
    from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

    class Numbering(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.last = handle.getValueState("last", "n bigint")
            self.seen = handle.getMapState("seen", "idem_key bigint", "seq bigint")

        def handleInputRows(self, key, rows, timers):
            import pandas as pd

            n = self.last.get()[0] if self.last.exists() else 0
            for frame in rows:
                out = []
                for idem in frame.sort_values("arrival")["idem_key"]:
                    if self.seen.containsKey((idem,)):
                        out.append((idem, self.seen.getValue((idem,))[0], False))
                    else:
                        n += 1
                        self.seen.updateValue((idem,), (n,))
                        out.append((idem, n, True))
                yield pd.DataFrame(out, columns=["idem_key", "seq", "fresh"])
            self.last.update((n,))

        def close(self) -> None:
            pass

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    one = writes.select("arrival", "idem_key", F.lit(0).alias("g")).groupBy("g")
    numbered = one.transformWithStateInPandas(Numbering(), "idem_key bigint, seq bigint, fresh boolean", "append", "none")
    return numbered.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
