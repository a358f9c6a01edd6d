"""Folds by parallel prefix against the same folds in plain Python, with blocks far smaller than a track."""

import math
import random

import pytest

from fellwalk.operators import fold, replay, track


def plain_gain(values, threshold=3.0):
    low, total = None, 0.0
    for v in values:
        if v is None:
            continue
        if low is None:
            low = v
        elif v > low + threshold:
            total, low = total + v - low, v
        elif v < low:
            low = v
    return total


def plain_monotone(rows):
    out, last = [], None
    for d, x, y, z in rows:
        if last is not None and (d is None or not d > last):
            d = last + math.dist((x, y, z), before)
        last, before = d, (x, y, z)
        out.append(d)
    return out


def plain_damped(rows, k, reset=1100.0):
    out, v = [], None
    for dt, target in rows:
        if target is not None:
            v = target if v is None or abs(target - v) > reset else v + (target - v) * (1 - math.exp(-k * min(dt or 0.0, 0.05)))
        out.append(v)
    return out


def tracks(seed):
    """Rising, flat, jumping, empty-handed and short tracks, with exact ties."""
    rng = random.Random(seed)
    yield [rng.gauss(0, 2) + i / 9 for i in range(700)]
    yield [5.0] * 400
    yield [1000.0 + rng.randrange(0, 40) / 10 for _ in range(600)]
    yield [rng.choice([0.0, 3.0, 110.0, 220.0, None]) for _ in range(500)]
    yield [None] * 70
    yield [7.25]
    yield [None, None, 4.0, 9.0]
    yield [1000.0 - i / 10 for i in range(300)]


@pytest.mark.parametrize("block", [1, 7, 64, 1 << 16])
def test_folds_equal_plain_ones(spark, monkeypatch, block):
    monkeypatch.setattr(fold.Fold.__new__, "__defaults__", (block, 0.0))
    monkeypatch.setattr(replay, "BLOCK", block)
    rng = random.Random(block)
    rows = [(t, i, v, rng.choice([i * 2.0, i * 1.0, 0.0, None]) if i else 0.0, rng.random(), rng.choice([0.0, 0.01, 0.05, 0.2, None])) for t, values in enumerate(tracks(block)) for i, v in enumerate(values)]
    spark.createDataFrame(rows, "track_id long, seq int, ele double, d double, x double, dt double").repartition(5).createOrReplaceTempView("fold_rows")
    by = {}
    for r in rows:
        by.setdefault(r[0], []).append(r)
    gains = {r.track_id: r.gain_m for r in track.ascent(spark.table("fold_rows")).collect()}
    assert gains.keys() == by.keys()
    for t, found in gains.items():
        assert found == pytest.approx(plain_gain([r[2] for r in by[t]]), abs=1e-9)
    d = spark.sql("SELECT track_id, seq, d, x, 1D AS y, seq * 0.5D AS z, 'extra' AS value FROM fold_rows")
    got = sorted((r.track_id, r.seq, r.d) for r in replay.monotone(d).collect())
    want = [(t, i, v) for t in by for i, v in enumerate(plain_monotone([(r[3], r[4], 1.0, r[1] * 0.5) for r in by[t]]))]
    assert [g[:2] for g in got] == [w[:2] for w in want] and [g[2] for g in got] == pytest.approx([w[2] for w in want], abs=1e-8)
    f = spark.sql("SELECT track_id AS id, seq, dt, ele * 10 AS target FROM fold_rows")
    got = sorted((r.id, r.seq, r.value) for r in replay.damped(f, 1.85).collect())
    want = [(t, i, v) for t in by for i, v in enumerate(plain_damped([(r[5], None if r[2] is None else r[2] * 10) for r in by[t]], 1.85))]
    assert [g[:2] for g in got] == [w[:2] for w in want]
    for g, w in zip(got, want, strict=True):
        assert g[2] is w[2] is None or g[2] == pytest.approx(w[2], abs=1e-7), (g, w)


def test_empty_table(spark):
    none = spark.createDataFrame([], "track_id long, seq int, ele double, d double, x double, y double, z double")
    assert not track.ascent(none).collect() and not replay.monotone(none).collect()


def test_a_long_track_is_many_tasks(spark):
    """One track of 31 blocks: its rows are dealt by block."""
    n = 2_000_000
    rows = spark.range(n).selectExpr("1L AS track_id", "CAST(id AS INT) AS seq", "CAST(id % 1000 AS DOUBLE) AS ele")
    assert track.ascent(rows).first().gain_m == pytest.approx(n / 1000 * 996, rel=0.01)
    plan = replay.damped(rows.selectExpr("track_id AS id", "seq", "0.02D AS dt", "ele AS target"), 1.85)._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [id#" in plan and "_block#" in plan
