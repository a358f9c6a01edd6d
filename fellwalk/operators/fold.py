"""Ordered folds over groups of any length, by parallel prefix.

The folds here hold their state while it lies in a window of each row and are reset by the row otherwise:
the dead-band of an ascent, the repair of distances, the damping of a camera. Between resets the value is
an affine map of what was held, so a block of rows is a short function of the value that enters it: held
through to the end, or thrown out first by one of a few rows, from where all is known. Blocks are composed
alike in many tasks, a scan over one row a block finds what enters each, and a second pass gives the values.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Numbers of `order` that one block spans: one block is held in memory, and one row of the scan stands for it.
BLOCK = 1 << 16


class Form(NamedTuple):
    """Rows after a block's first: what is held, u, stays while lo <= u + reach and u <= hi, and becomes `reset` otherwise.

    The value is scale * u + shift, and `raw` right after a reset. `sure` says whether a row throws out the `raw` of
    the row before, where that is decided on the values themselves.
    """

    lo: np.ndarray
    hi: np.ndarray
    reset: np.ndarray
    scale: np.ndarray
    shift: np.ndarray
    raw: np.ndarray
    sure: np.ndarray | None = None


class Fold(NamedTuple):
    """`first(row, row before, value before)`: the value after a block's first row (both others None at the start of a
    group). `form(rows)`: the Form of the rows after it. Rows are arrays of `values`, NULL is NaN. `reach`: see Form."""

    values: list[str]
    first: Callable[[np.ndarray, np.ndarray | None, float | None], float]
    form: Callable[[np.ndarray], Form]
    block: int = BLOCK
    reach: float = 0.0


def thrown_out(u, lo, hi, reach: float) -> np.ndarray:
    return ~((lo <= u + reach) & (u <= hi))


def next_exits(f: Form, reach: float) -> np.ndarray:
    """For each row the first later row that throws out its reset value, their number if none does: descent over
    windows of doubling length."""
    n = len(f.lo)
    los, his = [f.lo], [f.hi]
    while 1 << len(los) <= n:
        h = 1 << len(los) - 1
        los.append(np.maximum(los[-1][:-h], los[-1][h:]))
        his.append(np.minimum(his[-1][:-h], his[-1][h:]))
    at = np.arange(1, n + 1)
    for k in range(len(los) - 1, -1, -1):
        here = np.minimum(at, len(los[k]) - 1)
        at = at + ((at < len(los[k])) & ~thrown_out(f.reset, los[k][here], his[k][here], reach)) * (1 << k)
    if f.sure is not None and n > 1:  # the step to the next row is decided on values
        two = np.append(f.sure[1:], False)
        wrong = np.flatnonzero((at == np.arange(1, n + 1)) & ~two & (np.arange(n) < n - 1))
        for i in wrong:  # a difference in the last bit: rare
            out = np.flatnonzero(thrown_out(f.reset[i], f.lo[i + 2 :], f.hi[i + 2 :], reach))
            at[i] = i + 2 + out[0] if len(out) else n
        at = np.where(two, np.arange(1, n + 1), at)
    return at


class Block:
    """The orbits of a Form: `last` reset that follows each reset, and what resets add up to on the way upwards."""

    def __init__(self, f: Form, reach: float = 0.0, new: np.ndarray | None = None):
        self.form, self.reach, n = f, reach, len(f.lo)
        after = next_exits(f, reach)
        to = np.where(after < n, after, np.arange(n))
        gain = np.fmax(f.reset[to] - f.reset, 0.0) if n else np.zeros(0)
        if new is not None:
            gain = np.where(new[to], 0.0, gain)
        self.jumps, self.new = [to], new
        while True:
            gain = gain + gain[to]
            further = to[to]
            if np.array_equal(further, to):
                break
            to = further
            self.jumps.append(to)
        self.last, self.gain = to, gain

    def records(self) -> tuple[list, list, list, list, list]:
        """(lo, hi, value at the end, reset, gain after it) of rows that may be the first to throw a value out; of neighbours
        that come to the same, the last."""
        f, n = self.form, len(self.form.lo)
        if not n:
            return [], [], [], [], []
        lo, hi = np.maximum.accumulate(f.lo), np.minimum.accumulate(f.hi)
        new = np.append(True, (lo[1:] > lo[:-1]) | (hi[1:] < hi[:-1]))
        shut = np.flatnonzero(lo - hi > self.reach + 1e-6)  # nothing is left inside; the margin only keeps more
        if len(shut):
            new[shut[0] + 1 :] = False
        k = np.flatnonzero(new)
        end = np.where(self.last[k] == n - 1, f.raw[-1], f.scale[-1] * f.reset[self.last[k]] + f.shift[-1])
        gain, reset = self.gain[k], f.reset[k]
        last = np.append((end[1:] != end[:-1]) | (reset[1:] != reset[:-1]) | (gain[1:] != gain[:-1]), True)
        return lo[k][last].tolist(), hi[k][last].tolist(), end[last].tolist(), reset[last].tolist(), gain[last].tolist()

    def gains(self, u: float, starts: list[int]) -> np.ndarray:
        """What resets add up to in each group of rows, if u is held on entry."""
        f = self.form
        out = np.flatnonzero(thrown_out(u, f.lo, f.hi, self.reach))[:1]
        own = [float(np.fmax(f.reset[i] - u, 0.0)) * (self.new is None or not self.new[i]) + self.gain[i] for i in out] or [0.0]
        sums = np.array([*own, *(self.gain[s - 1] for s in starts[1:]), 0.0])
        return sums[:-1] - sums[1:]

    def values(self, u: float) -> np.ndarray:
        """The value of each row if u is held on entry."""
        f, n = self.form, len(self.form.lo)
        out = np.flatnonzero(thrown_out(u, f.lo, f.hi, self.reach))
        at = np.zeros(n, bool)
        if len(out):
            at[out[0]] = True
            for to in self.jumps:
                at[to[at]] = True
        last = np.maximum.accumulate(np.where(at, np.arange(n), -1)) if n else np.zeros(0, int)
        held = np.where(last >= 0, f.reset[last], u) if n else np.zeros(0)
        return np.where(at, f.raw, f.scale * held + f.shift)


def blocks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[pa.Table, list[int]]]:
    """Rows of sorted batches and where groups begin in them: each (key, block), the first two columns, on its own, but
    first blocks of several groups together as long as they have `most` rows at most."""
    kept = None
    for b in batches:
        t = pa.Table.from_batches([b])
        t = (t if kept is None else pa.concat_tables([kept, t])).combine_chunks()
        if not t.num_rows:
            continue
        change = np.zeros(t.num_rows - 1, bool)
        for i in (0, 1):
            ids = t.column(i).combine_chunks().dictionary_encode("encode")
            change |= np.diff(np.asarray(ids.indices)) != 0
        cuts = np.append(0, np.flatnonzero(change) + 1)
        first = np.asarray(t.column(1).take(cuts)) == 0
        yield from together(t, cuts.tolist(), first.tolist(), most)
        kept = t.slice(cuts[-1])
    if kept is not None:
        yield kept, [0]


def together(t: pa.Table, cuts: list[int], first: list[bool], most: int) -> Iterator[tuple[pa.Table, list[int]]]:
    """All but the last group, which may go on."""
    held: list[int] = []
    for start, end, alone in zip(cuts, cuts[1:], (not x for x in first), strict=False):
        if held and (alone or end - held[0] > most):
            yield t.slice(held[0], start - held[0]), [h - held[0] for h in held]
            held = []
        held.append(start)
        if alone:
            yield t.slice(start, end - start), [0]
            held = []
    if held:
        yield t.slice(held[0], cuts[-1] - held[0]), [h - held[0] for h in held]


def block_of(fold: Fold, m: np.ndarray, starts: list[int]) -> Block:
    """Rows of several groups as one block: the first row of each throws everything out."""
    f = fold.form(m)
    if len(starts) > 1:
        new = np.zeros(len(f.lo), bool)
        new[np.array(starts[1:]) - 1] = True
        f = f._replace(lo=np.where(new, np.inf, f.lo), sure=None if f.sure is None else f.sure | new)
        return Block(f, fold.reach, new)
    return Block(f, fold.reach)


def matrix(t: pa.Table, names: list[str]) -> np.ndarray:
    return np.column_stack([t.column(c).to_numpy().astype(float) for c in names])


def prepared(rows: DataFrame, key: str, order: str, fold: Fold) -> DataFrame:
    values = [F.col(v).cast("double").alias(v) for v in fold.values]
    return rows.select(key, F.greatest(F.floor(F.col(order) / fold.block).cast("long"), F.lit(0)).alias("_block"), order, *values)


def entered(rows: DataFrame, key: str, order: str, fold: Fold) -> DataFrame:
    """(key, block, state: value and row before it, gain before its end) for each block: what enters it."""
    kind = rows.schema[key].dataType.simpleString()
    p = prepared(rows, key, order, fold).repartition(key, "_block").sortWithinPartitions(key, "_block", order)
    parts = ["ends", "held", "lo", "hi", "end", "reset", "gain"]
    schema = f"{key} {kind}, _block long, " + ", ".join(f"{c} array<double>" for c in parts)

    def summaries(batches):
        ids, found = [], []

        def flush():
            both = pa.concat_tables(ids)
            columns = [pa.array(c, pa.list_(pa.float64())) for c in zip(*found, strict=True)]
            ids.clear(), found.clear()
            return pa.table([*both.columns, *columns], [key, "_block", *parts]).combine_chunks().to_batches()

        for t, starts in blocks(batches, fold.block):
            m = matrix(t, fold.values)
            ends = np.array([*starts[1:], len(m)]) - 1
            b = block_of(fold, m, starts)
            ids.append(t.select([0, 1]).take(starts))
            if t.column(1)[0].as_py():  # what enters is not known yet
                held = [b.form.scale[-1], b.form.shift[-1]] if len(m) > 1 else [1.0, 0.0]
                found.append(([*m[0], *m[-1]], held, *b.records()))
                continue
            u = fold.first(m[0], None, None)
            v, gain = np.append(u, b.values(u)), b.gains(u, starts)
            found.extend(([*m[i], *m[j]], [0.0, v[j]], [], [], [], [], [g]) for i, j, g in zip(starts, ends, gain, strict=True))
            if len(ids) == 256:
                yield from flush()
        if ids:
            yield from flush()

    def scan(batches):
        now = before = value = None
        total, n = 0.0, len(fold.values)
        for b in batches:
            states, totals = [], []
            for s in b.to_pylist():
                if before is None or s[key] != now:
                    now, before, value, total = s[key], None, None, 0.0
                states.append(None if before is None else [value, *before])
                u = fold.first(np.array(s["ends"][:n]), before, value)
                if value is not None:
                    total += float(np.fmax(u - value, 0.0))
                out = np.flatnonzero(thrown_out(u, np.array(s["lo"]), np.array(s["hi"]), fold.reach)) if s["lo"] else []
                if len(out):
                    value = s["end"][out[0]]
                    total += float(np.fmax(s["reset"][out[0]] - u, 0.0)) + s["gain"][out[0]]
                else:
                    value = s["held"][0] * u + s["held"][1] if s["held"][0] else s["held"][1]
                    total += sum(s["gain"]) if s["_block"] == 0 else 0.0
                before = np.array(s["ends"][n:])
                totals.append(total)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(states, pa.list_(pa.float64())), pa.array(totals, pa.float64())], [key, "_block", "_state", "_gain"])

    found = p.mapInArrow(summaries, schema).repartition(key).sortWithinPartitions(key, "_block")
    return found.mapInArrow(scan, f"{key} {kind}, _block long, _state array<double>, _gain double")


def folded(rows: DataFrame, key: str, order: str, fold: Fold, result: str) -> DataFrame:
    """key, order, the fold's values and `result` of every row. `order` is a number of a row in its group; dense numbers make
    even blocks, those below 0 are in the first one. A result is NULL until the first row that has one."""
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    names = [key, order, *fold.values]
    p = prepared(rows, key, order, fold).withColumn("_state", F.lit(None).cast("array<double>"))
    starts = entered(rows, key, order, fold).where("_state is not null").select(key, "_block", "_state")
    both = p.unionByName(starts, allowMissingColumns=True).repartition(key, "_block").sortWithinPartitions(key, "_block", F.col("_state").isNull(), order)
    schema = ", ".join([f"{key} {kinds[key]}", f"{order} {kinds[order]}", *(f"{v} double" for v in fold.values), *([] if result in names else [f"{result} double"])])

    def run(batches):
        for t, starts in blocks(batches, fold.block):
            state = t.column("_state")[0].as_py()
            t = t.slice(0 if state is None else 1)
            m = matrix(t, fold.values)
            before = None if state is None else np.array(state[1:])
            u = fold.first(m[0], before, None if state is None else state[0])
            v = np.append(u, block_of(fold, m, starts).values(u))
            new = pa.array(v, pa.float64(), from_pandas=True)
            t = t.select(names)
            t = t.set_column(names.index(result), result, new) if result in names else t.append_column(result, new)
            yield from t.combine_chunks().to_batches()

    return both.mapInArrow(run, schema)


def gains(rows: DataFrame, key: str, order: str, fold: Fold, result: str) -> DataFrame:
    """key and what the resets of the whole group add up to on the way upwards."""
    return entered(rows, key, order, fold).groupBy(key).agg(F.max_by("_gain", "_block").alias(result))
