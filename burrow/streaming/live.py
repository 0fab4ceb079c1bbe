"""Live changes: a stream of journal records folded into snapshot versions, and standing queries.

The fold needs the parent of a new entry, which is another key's state, so it runs as
a join over the whole batch in ``foreachBatch`` and not as state per key. Only drives
that the batch changes are folded and written anew; the others' rows stay where they are,
and a batch that changes nothing notes its last usn alone. A batch and its last usn become
visible in one manifest; records at or below that usn are dropped when a batch is run
again, so each is applied once.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from burrow.operators import journal as J
from burrow.operators import tree
from burrow.sources import snapshot


@dataclass
class LiveIndex:
    """A snapshot that follows a journal."""

    spark: SparkSession
    path: str
    schema: object
    apply_moves: bool = False
    listeners: list[Callable[[DataFrame], None]] = field(default_factory=list)

    def entries(self) -> DataFrame:
        manifest = snapshot.read_manifest(self.spark, self.path)
        return snapshot.load(self.spark, self.path, {d: s["volume_serial"] for d, s in manifest.drives.items()}, self.schema)

    def apply(self, batch: DataFrame, batch_id: int = -1) -> bool:
        """Folds a batch; False if nothing in it applies. Positions are numbered anew, as in a rebuild."""
        states = snapshot.read_manifest(self.spark, self.path).drives
        last = self.spark.createDataFrame([(d, int(s["last_usn"])) for d, s in states.items()], "drive string, last_usn long")
        fresh = tree.cut(batch.join(F.broadcast(last), "drive").where("usn > last_usn").drop("last_usn"))  # one row a drive
        ends = {r["drive"]: r["usn"] for r in fresh.groupBy("drive").agg(F.max("usn").alias("usn")).collect()}
        if not ends:
            return False
        after = {d: {**states[d], "last_usn": usn} for d, usn in ends.items()}
        changed = [r["drive"] for r in fresh.where(J.action(F.col("reason")) != "-").select("drive").distinct().collect()]
        if quiet := {d: s for d, s in after.items() if d not in changed}:
            snapshot.update(None, self.path, quiet)
        if changed:
            now = self.entries().where(F.col("drive").isin(changed))
            raw = J.apply(now, fresh, self.apply_moves)
            now = tree.build(raw, "mft_ref", "is_deleted", "name").select(*now.columns)
            snapshot.update(now, self.path, {d: after[d] for d in changed})
            for tell in self.listeners:
                tell(self.entries())
        return bool(changed)

    def follow(self, journal: DataFrame, checkpoint: str, available_now: bool = False, every: str = "500 milliseconds") -> StreamingQuery:
        """Starts folding a streaming journal; with ``available_now`` it stops when it has caught up."""
        trigger = {"availableNow": True} if available_now else {"processingTime": every}
        return journal.writeStream.foreachBatch(self.apply).option("checkpointLocation", checkpoint).trigger(**trigger).start()


@dataclass
class StandingQuery:
    """Runs the last query again once changes have ceased for a while; a newer query supersedes an older one."""

    run: Callable[[str], object]
    wait: float = 0.5
    clock: Callable[[], float] = time.monotonic
    text: str = ""
    _due: float | None = None
    _sequence: int = 0

    def search(self, text: str):
        """Runs a query now; its result is dropped if another came in meanwhile."""
        self._sequence += 1
        mine, self.text, self._due = self._sequence, text, None
        result = self.run(text)
        return result if mine == self._sequence else None

    def changed(self) -> None:
        self._due = self.clock() + self.wait

    def poll(self, shown: str, busy: bool = False):
        """Called from time to time: the fresh result, or None if nothing is due, the text has changed, or the user is busy."""
        if self._due is None or self.clock() < self._due or busy:
            return None
        self._due = None
        return self.search(self.text) if shown == self.text and shown else None


def journal_stream(spark: SparkSession, folder: str, drive: str, files_a_batch: int = 64) -> DataFrame:
    """A stream of journal rows from binary files that arrive in a folder; a batch takes so many files at most, so a backlog
    is worked off in batches of bounded size.
    """
    from burrow.sources.mft import read_journal

    kind = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(kind).option("maxFilesPerTrigger", files_a_batch).load(folder)
    return read_journal(files, drive)


def metrics(query: StreamingQuery) -> dict:
    """Of a running fold: batches, rows of the last batch and rows a second."""
    last = query.lastProgress or {}
    return {"batch": last.get("batchId", -1), "rows": last.get("numInputRows", 0), "rows_a_second": last.get("processedRowsPerSecond", 0.0)}


def superseding(spark: SparkSession, tag: str = "burrow-search"):
    """Cancels the running search and tags the next: for sessions where jobs are run from several threads."""
    spark.interruptTag(tag) if hasattr(spark, "interruptTag") else spark.sparkContext.cancelJobsWithTag(tag)
    spark.addTag(tag) if hasattr(spark, "addTag") else spark.sparkContext.addJobTag(tag)
