"""Job states as a stream: events out of order over batches, repeated events, gaps and expiry."""

import datetime as dt

import numpy as np
from pyspark.sql import Row
from pyspark.sql import functions as F

from fellwalk.operators import jobs
from fellwalk.streaming import jobs as streams

EVENTS = "job_id long, seq int, kind string, pct int"


def test_events_in_any_order(spark, tmp_path):
    log = [(j, s, "submit" if s == 0 else "cancel" if j % 3 == 0 and s == 9 else "finish" if j % 3 == 1 and s == 7 + j % 4 else "progress", (s * 37 + j) % 120) for j in range(12) for s in range(14)]
    for n in range(5):  # every file holds events of every job, the latest first; the last repeats the first
        part = [e for e in log if (e[1] * 3 + e[0]) % 4 == n % 4]
        spark.createDataFrame(part[::-1], EVENTS).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/log")
    got = streams.replay(spark, EVENTS, f"file://{tmp_path}/log", f"file://{tmp_path}/run", 1)
    assert sorted(got.collect()) == sorted(jobs.states(spark.createDataFrame(log, EVENTS)).collect())
    assert len({r.batch for r in spark.read.parquet(f"file://{tmp_path}/run/states").select("batch").distinct().collect()}) == 5


def test_silent_jobs_end(spark, tmp_path):
    """Job 1 lacks event 1, so event 2 waits; an hour of silence ends it with what it has, and its state is dropped."""
    own = streams.streaming_session(spark)
    at = lambda m: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m)
    batches = [[(1, 0, "submit", 0, at(0)), (1, 2, "finish", 0, at(1))], [(2, 0, "progress", 40, at(200))], [(2, 1, "progress", 20, at(201))], [(1, 0, "progress", 7, at(205))]]
    schema = f"{EVENTS}, at timestamp"
    seen = []
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/log")
        stream = own.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/log")
        q = streams.job_states(stream, "at").writeStream.outputMode("update").option("checkpointLocation", f"file://{tmp_path}/progress").foreachBatch(lambda b, _: seen.append(sorted(map(tuple, b.collect())))).trigger(availableNow=True).start()
        q.awaitTermination()
    flat = [r for b in seen for r in b]
    assert flat[0] == (1, "queued", 2) and (1, "ready", 100) in flat  # on expiry
    assert flat[-1] == (1, "processing", 7)  # anew
    assert [r for r in flat if r[0] == 2] == [(2, "processing", 40)] * 2


def test_first_uploads(spark, tmp_path):
    own = streams.streaming_session(spark)
    schema = "page_id long, text string, quality string, at timestamp"
    t = dt.datetime(2024, 1, 1)
    rows = [(i, "<gpx>%d</gpx>" % (i % 3), "high", t + dt.timedelta(seconds=i)) for i in range(30)]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"file://{tmp_path}/in")
    first = streams.first_uploads(own.readStream.schema(schema).parquet(f"file://{tmp_path}/in"), "at")
    seen = []
    first.writeStream.option("checkpointLocation", f"file://{tmp_path}/progress").foreachBatch(lambda b, _: seen.extend(b.collect())).trigger(availableNow=True).start().awaitTermination()
    want = jobs.deduplicated(spark.createDataFrame(rows, schema)).select(F.col("job_id")).collect()
    assert sorted(r.job_id for r in seen) == sorted(r.job_id for r in want)


class Held:
    """State in memory, one key's, that counts its calls."""

    def __init__(self):
        self.value, self.map, self.calls = None, {}, 0

    def getValueState(self, *_):
        return self

    getMapState = getValueState

    def counted(answer):  # noqa: N805
        def call(self, *args):
            self.calls += 1
            return answer(self, *args)

        return call

    exists = counted(lambda self: self.value is not None)
    get = counted(lambda self: self.value)
    update = counted(lambda self, value: setattr(self, "value", value))
    clear = counted(lambda self: None)
    iterator = counted(lambda self: iter(self.map.items()))
    containsKey = counted(lambda self, k: k in self.map)
    getValue = counted(lambda self, k: self.map.get(k))
    updateValue = counted(lambda self, k, v: self.map.update({k: v}))
    removeKey = counted(lambda self, k: self.map.pop(k))


def batches_of(log, order, size):
    for at in range(0, len(order), size):
        yield [Row(seq=log[i][0], kind=log[i][1], pct=log[i][2]) for i in order[at : at + size]]


def plain(log):
    status, progress = "queued", 2
    for _, kind, pct in sorted(log):
        if kind in ("cancel", "finish"):
            return ("error", progress) if kind == "cancel" else ("ready", 100)
        if kind == "progress":
            status, progress = "processing", max(progress, min(99, pct))
    return status, progress


def test_calls_to_the_store():
    """Early events of a job are kept together: 60 of them cost a read and a write of each batch."""
    log = [(i, "submit" if i == 0 else "progress", i) for i in range(60)]
    held = Held()
    processor = streams.JobFold()
    processor.init(held)
    for rows in batches_of(log, range(59, -1, -1), 20):
        out = list(processor.handleInputRows((1,), iter(rows), None))
    assert out == [(1, "processing", 59)] and held.calls <= 6


def test_long_jobs_in_any_order(monkeypatch):
    """Jobs of several chunks against a plain loop: in order, backwards, shuffled, with repeats, ends at and around the chunks' borders, and with a gap."""
    monkeypatch.setattr(streams, "MOST", 400)
    rng = np.random.default_rng(3)
    for n, end in ((2, None), (1024, "finish"), (1025, "cancel"), (5000, None), (5000, "cancel")):
        log = [(i, "other" if i % 7 == 0 else "progress", int(rng.integers(-5, 130))) for i in range(n)]
        if end:
            log[-1 - n // 3] = (log[-1 - n // 3][0], end, 0)
        for order in (np.arange(n), np.arange(n)[::-1], rng.permutation(n), rng.integers(0, n, 8 * n), np.flatnonzero(np.arange(n) != n // 2)):
            order = np.concatenate((order, rng.permutation(n))) if len(order) > n else order
            held = Held()
            processor = streams.JobFold()
            processor.init(held)
            for rows in batches_of(log, order, 700):
                out = list(processor.handleInputRows((1,), iter(rows), None))
            if len(order) < n:
                assert out[0][1:] == plain(log[: n // 2])
                out = list(processor.handleExpiredTimer((1,), None, None)) or out
                assert out[0][1:] == plain(log[: n // 2] + log[n // 2 + 1 :])
            else:
                assert out[0][1:] == plain(log) and not held.map
