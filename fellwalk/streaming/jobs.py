"""Streaming forms of the job operators: the state fold and the dedup of uploads."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator
from itertools import islice

import numpy as np
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.jobs import with_job_id

#: The state store that processors with maps and timers need.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUT = "job_id long, status string, progress int"


#: Consecutive events that wait together, one byte each: 0 for none, OTHER, CANCEL, FINISH, or FIRST + the progress up to 99.
CHUNK = 1024
OTHER, CANCEL, FINISH, FIRST = 1, 2, 3, 4
#: Events of a job that are sorted in at once.
MOST = 10_000


def coded(kind: str | None, pct: int | None) -> int:
    """The byte of an event. Progress below 0 or above 99 counts as 0 or 99, a missing one as 99."""
    if kind == "progress":
        return FIRST + (99 if pct is None else min(max(pct, 0), 99))
    return CANCEL if kind == "cancel" else FINISH if kind == "finish" else OTHER


def fold(state: tuple[str, int], events: np.ndarray) -> tuple[str, int]:
    """State of a job after events in order: the first end decides, progress never falls."""
    status, progress = state
    if status in ("error", "ready"):
        return state
    ends = np.flatnonzero((events == CANCEL) | (events == FINISH))
    moves = events[: ends[0] if len(ends) else None]
    moves = moves[moves >= FIRST]
    if len(moves):
        status, progress = "processing", max(progress, int(moves.max()) - FIRST)
    if len(ends):
        return ("error", progress) if events[ends[0]] == CANCEL else ("ready", 100)
    return status, progress


def _milliseconds(at: dt.datetime) -> int:
    return int((at if at.tzinfo else at.replace(tzinfo=dt.UTC)).timestamp() * 1000)


class JobFold(StatefulProcessor):
    """Folds each job's events in the order of seq, from 0 on, in whatever order they arrive.

    An event ahead of its turn waits until those before it have come. Those of the chunk of the event that is due are kept with
    the job's state, so that a job of up to CHUNK events costs one read and one write of the store a batch; those of later chunks in a
    map, on disk with the other state, one value a chunk. An event that came before is passed over. With `event_time`, a job that
    hears nothing for ttl_ms of event time ends: what still waits is folded in order, gaps or not, and the state is dropped.
    """

    def __init__(self, event_time: str | None = None, ttl_ms: int = 3_600_000):
        self.event_time, self.ttl_ms = event_time, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.now = handle.getValueState("now", "due int, far int, status string, progress int, ends long, near binary")
        self.early = handle.getMapState("early", "chunk int", "events binary")

    def _waiting(self, number: int) -> np.ndarray:
        """What waits of a chunk, none if nothing."""
        held = self.early.getValue((number,))
        return np.frombuffer(bytes(held[0]) if held else bytes(CHUNK), np.uint8).copy()

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        due, far, *state, ends, held = self.now.get() or (0, 0, "queued", 2, -1, b"")
        state, last = tuple(state), ends
        near = np.zeros(CHUNK, np.uint8)  # the chunk of the event that is due; what waits in it
        near[due % CHUNK : due % CHUNK + len(held)] = np.frombuffer(bytes(held), np.uint8)
        while part := list(islice(rows, MOST)):
            if self.event_time:
                last = max(last, *(_milliseconds(r[self.event_time]) + self.ttl_ms for r in part))
            seqs, first = np.unique(np.array([r["seq"] for r in part]), return_index=True)
            events = np.array([coded(r["kind"], r["pct"]) for r in part], np.uint8)[first]
            events, seqs = events[seqs >= due], seqs[seqs >= due]
            numbers = seqs // CHUNK
            cuts = np.flatnonzero(np.diff(numbers)) + 1
            for at, new in zip(np.split(seqs, cuts), np.split(events, cuts), strict=True):
                if not len(at):
                    continue
                number, at = int(at[0]) // CHUNK, at % CHUNK
                if number > due // CHUNK:
                    chunk = self._waiting(number)
                    far += not chunk.any()
                    chunk[at] = np.where(chunk[at] == 0, new, chunk[at])
                    self.early.updateValue((number,), (chunk.tobytes(),))
                    continue
                near[at] = np.where(near[at] == 0, new, near[at])
                while near[due % CHUNK]:
                    ready = near[due % CHUNK :]
                    gaps = np.flatnonzero(ready == 0)
                    ready = ready[: gaps[0]] if len(gaps) else ready
                    state, due = fold(state, ready), due + len(ready)
                    if due % CHUNK:
                        break
                    near = self._waiting(due // CHUNK) if far else np.zeros(CHUNK, np.uint8)
                    if near.any():
                        self.early.removeKey((due // CHUNK,))
                        far -= 1
        if last > ends:
            if ends >= 0:
                self.handle.deleteTimer(ends)
            self.handle.registerTimer(last)
        self.now.update((due, far, *state, last, near[due % CHUNK :].tobytes().rstrip(b"\0")))
        yield Row(job_id=key[0], status=state[0], progress=state[1])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        _, far, *state, _, near = self.now.get()
        state = tuple(state)
        if near or far:
            later = sorted((k[0], bytes(v[0])) for k, v in self.early.iterator()) if far else []
            for events in (bytes(near), *(v for _, v in later)):
                state = fold(state, np.frombuffer(events, np.uint8))
            yield Row(job_id=key[0], status=state[0], progress=state[1])
        self.early.clear()
        self.now.clear()

    def close(self) -> None:
        pass


def job_states(events: DataFrame, event_time: str | None = None, late: str = "10 minutes", ttl_ms: int = 3_600_000) -> DataFrame:
    """Stream of (job_id, seq, kind, pct) to a stream of (job_id, status, progress) after each batch, see JobFold. Its session's
    state store has to be STORE. Without `event_time`, a timestamp column, state stays; with it, events older than the watermark,
    `late` behind the newest, no longer count."""
    if event_time:
        events = events.withWatermark(event_time, late)
    return events.groupBy("job_id").transformWithState(JobFold(event_time, ttl_ms), OUT, "Update", "EventTime" if event_time else "None")


def first_uploads(uploads: DataFrame, event_time: str, late: str = "1 hour") -> DataFrame:
    """First upload of each content hash; state is kept as long as the watermark allows a repeat."""
    return with_job_id(uploads).withWatermark(event_time, late).dropDuplicatesWithinWatermark(["job_id"])


def streaming_session(spark: SparkSession) -> SparkSession:
    """A session of its own with the state store that job_states needs."""
    own = spark.newSession()
    own.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    own.conf.set("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"))
    return own


def replay(spark: SparkSession, schema: str, source: str, folder: str, files: int = 64) -> DataFrame:
    """Runs the fold over the Parquet files of a finished log, `files` at a time, and returns the last state of
    each job. Any file may hold any event. States are written as Parquet under `folder`, progress too: a run that was broken off goes on there."""
    stream = streaming_session(spark).readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(source)

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/states/batch={number}")  # a batch that runs again replaces its own

    query = job_states(stream).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start()
    query.awaitTermination()
    states = spark.read.schema(f"{OUT}, batch long").parquet(f"{folder}/states")
    return states.groupBy("job_id").agg(F.max_by(F.struct("status", "progress"), "batch").alias("s")).select("job_id", "s.status", "s.progress")
