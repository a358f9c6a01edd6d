"""Packing documents into windows by the sum-of-squares rule.

Documents become token ids, end mark included. Whole windows are cut off a long document; each rest is
placed online by the move that makes the sum of squared counts of partially filled windows, taken over
fill levels, least. A move may also fill a window up and cut the document, at a price, so the number of
open windows stays bounded for every mix of lengths and none is closed early.

Partitions pack on their own. The windows that they leave open, a bounded number each, are packed on by the
same rule in groups of partitions, what those leave open in groups of groups, and so on until one group is
left. Only what that one leaves open, no more than a partition does, is dealt into full windows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, stored, table

WINDOW, END = 2048, 1
#: Fill levels of a window; squared counts that a cut has to save; partitions whose open windows are packed on together.
LEVELS, CUT, TOGETHER = 64, 3, 8
#: Bits of a window number below its partition.
SHIFT = 36
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Encoder:
    """Token ids of a vocabulary file of the `tokenizers` library.

    A byte-level file of the same vocabulary for `tiktoken` gives the same ids several times faster; a
    text that spells a special token goes through `tokenizers` itself, which knows those.
    """

    def __init__(self, path: str, fast_path: str | None = None, pattern: str | None = None):
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(path)
        self.special = [t.content for t in self.slow.get_added_tokens_decoder().values()]
        self.fast = None
        if fast_path and pattern:
            import base64

            import tiktoken

            with open(fast_path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> np.ndarray:
        if self.fast is not None and not any(s in text for s in self.special):
            try:
                return np.array(self.fast.encode_ordinary(text), np.uint32)
            except BaseException as error:  # a run of a million blanks exhausts the stack of its pattern
                if type(error).__name__ != "PanicException":
                    raise
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, np.uint32)


class Piece(NamedTuple):
    """Ids [start, start + len(ids)) of a document of `tokens` ids."""

    doc: int | None
    start: int
    ids: np.ndarray
    tokens: int


def cut(pieces: list[Piece], n: int) -> tuple[list[Piece], list[Piece]]:
    """The first n ids of pieces laid end to end, and the others."""
    for k, p in enumerate(pieces):
        if n <= 0:
            return pieces[:k], pieces[k:]
        if n < len(p.ids):
            return [*pieces[:k], p._replace(ids=p.ids[:n])], [Piece(p.doc, p.start + n, p.ids[n:], p.tokens), *pieces[k + 1 :]]
        n -= len(p.ids)
    return pieces, []


class SumOfSquares:
    """Online packing with a level array.

    count[c] windows are partially filled to level c (fills c * size / levels, exclusive, to (c + 1) * size / levels);
    open[c] holds them as (window, fill, pieces) and top[c] is the fill of the one that is used next.
    """

    def __init__(self, size: int = WINDOW, levels: int = LEVELS, price: int = CUT):
        self.size, self.step, self.price = size, -(-size // levels), price
        n = -(-size // self.step)
        self.count, self.top = np.zeros(n, np.int64), np.zeros(n, np.int64)
        self.open: list[list[tuple[int, int, list[Piece]]]] = [[] for _ in range(n)]

    def moves(self, n: int) -> np.ndarray:
        """Change of the sum of squares for each level whose window takes n ids; a cut has its price added."""
        full = self.top + n
        rest = np.where(full <= self.size, full, full - self.size)  # fill of the window that the ids end in
        then = np.minimum((rest - 1) // self.step, len(self.count) - 1)
        here = np.arange(len(self.count))
        gain = np.where(full == self.size, 0, 2 * (self.count[then] - (then == here)) + 1)
        change = 1 - 2 * self.count + gain + self.price * (full > self.size)
        return np.where(self.count > 0, change, np.iinfo(np.int64).max)

    def place(self, window: int, pieces: list[Piece]) -> Iterator[tuple[int, list[Piece]]]:
        """Places pieces of fewer than `size` ids as one; yields full windows. `window` is the number they may open."""
        n = sum(len(p.ids) for p in pieces)
        while n:
            change = self.moves(n)
            c = len(change) - 1 - int(np.argmin(change[::-1]))  # ties: the fullest
            if change[c] > 2 * self.count[(n - 1) // self.step] + 1:
                self.push(window, n, pieces)
                return
            into, fill, held = self.open[c].pop()
            self.count[c] -= 1
            self.top[c] = self.open[c][-1][1] if self.open[c] else 0
            now, pieces = cut(pieces, self.size - fill)
            n -= self.size - fill
            if n < 0:
                self.push(into, self.size + n, held + now)
                return
            yield into, held + now

    def push(self, window: int, fill: int, pieces: list[Piece]) -> None:
        c = (fill - 1) // self.step
        self.open[c].append((window, fill, pieces))
        self.count[c] += 1
        self.top[c] = fill

    def left(self) -> list[tuple[int, int, list[Piece]]]:
        """Open windows, in order of their numbers."""
        return sorted((w for level in self.open for w in level), key=lambda w: w[0])


def powers(n: int) -> list[int]:
    """n as falling powers of two."""
    return [1 << k for k in range(n.bit_length() - 1, -1, -1) if n >> k & 1]


def settle(pieces: list[Piece], size: int, first: int) -> Iterator[tuple[int, list[Piece]]]:
    """Deals pieces into windows without padding, numbered from `first`: laid end to end and cut into full
    windows; the last, shorter stretch is cut at powers of two, which need no padding."""
    total = sum(len(p.ids) for p in pieces)
    for k, n in enumerate([size] * (total // size) + powers(total % size)):
        now, pieces = cut(pieces, n)
        yield first + k, now


def pack_documents(docs: Iterable[tuple[int | None, np.ndarray]], first: int = 0, size: int = WINDOW) -> Iterator[tuple[int, list[Piece], bool]]:
    """(window, pieces, open) for (document, ids) pairs. Full windows leave at once, open ones at the end."""
    rule, window = SumOfSquares(size), first
    for doc, ids in docs:
        whole = len(ids) // size * size
        for start in range(0, whole, size):
            yield window, [Piece(doc, start, ids[start : start + size], len(ids))], False
            window += 1
        if whole < len(ids):
            for w, pieces in rule.place(window, [Piece(doc, whole, ids[whole:], len(ids))]):
                yield w, pieces, False
            window += 1
    for w, _, pieces in rule.left():
        yield w, pieces, True


def pack_on(windows: Iterable[tuple[int, list[Piece]]], first: int | None, size: int = WINDOW) -> Iterator[tuple[int, list[Piece], bool]]:
    """Packs open windows on by the same rule: (window, pieces, open). With `first`, what is left is settled in windows
    numbered from there and none is open."""
    rule = SumOfSquares(size)
    for window, pieces in windows:
        for w, full in rule.place(window, pieces):
            yield w, full, False
    if first is None:
        yield from ((w, pieces, True) for w, _, pieces in rule.left())
    else:
        yield from ((w, pieces, False) for w, pieces in settle([p for _, _, pieces in rule.left() for p in pieces], size, first))


def rows_of(windows: Iterable[tuple[int, list[Piece], bool]], most: int = 20_000) -> Iterator[pa.RecordBatch]:
    """Rows of SCHEMA, and the ids (null unless the window is open)."""
    cols: list[list] = [[] for _ in range(8)]
    names = [*(x.split()[0] for x in SCHEMA.split(", ")), "ids"]

    def batch():
        out = pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:7]), pa.array(cols[7], pa.binary())], names)
        for c in cols:
            c.clear()
        return out

    for window, pieces, is_open in windows:
        offset = 0
        for p in pieces:
            raw = p.ids.astype("<u4").tobytes()
            for c, v in zip(cols, (p.doc, p.start, len(p.ids), zlib.crc32(raw), p.tokens, window, offset, raw if is_open else None), strict=True):
                c.append(v)
            offset += len(p.ids)
        if len(cols[0]) >= most:
            yield batch()
    if cols[0]:
        yield batch()


def pack(docs: DataFrame, path: str, fast_path: str | None = None, pattern: str | None = None, size: int = WINDOW, together: int = TOGETHER) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A null or empty text is its end mark alone. Rows with the same doc_id are packed one by one. An empty
    table gives no rows. sequence_id holds the partition in its upper bits, so it is unique. What the
    partitions pack is written once to the shared folder, as encoding is the costly part; of the ids, only
    those of open windows are written and shuffled, at most a few hundred windows of a partition or of a group. Groups take
    `together` partitions, then as many groups, until there is one: so many rounds as that number's power needs to reach
    the number of partitions, each on an eighth of the windows of the one before.
    """

    def run(batches):
        encode = Encoder(path, fast_path, pattern)

        def documents():
            for b in chunks(batches):
                for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    yield doc, np.append(encode(text or ""), np.uint32(END))

        yield from rows_of(pack_documents(documents(), TaskContext.get().partitionId() << SHIFT, size))

    def on(t: pa.Table, first: int | None) -> pa.Table:
        t = t.sort_by([("sequence_id", "ascending"), ("offset", "ascending")])
        windows: dict[int, list[Piece]] = {}
        for doc, start, tokens, window, raw in zip(*(t.column(c).to_pylist() for c in ("doc_id", "start", "doc_tokens", "sequence_id", "ids")), strict=True):
            windows.setdefault(window, []).append(Piece(doc, start, np.frombuffer(raw, "<u4"), tokens))
        return pa.Table.from_batches(rows_of(pack_on(windows.items(), first, size)))

    rows = SCHEMA + ", ids binary"
    packed = stored(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, rows), "packed")
    done = [packed.where("ids is null")]
    still = packed.where("ids is not null")
    last = (still.agg(F.max("sequence_id")).first()[0] or 0) >> SHIFT  # the last partition that left a window open
    span = together
    while last >= span:
        group = F.expr(f"(sequence_id >> {SHIFT}) div {span}").alias("together")
        level = stored(still.groupBy(group).applyInArrow(lambda t: on(t, None), rows), "packed-on")
        done.append(level.where("ids is null"))
        still, span = level.where("ids is not null"), span * together
    done.append(still.groupBy(F.lit(0).alias("together")).applyInArrow(lambda t: on(t, 1 << 62), rows))
    return reduce(DataFrame.unionByName, done).drop("ids")


def pack_public(docs: DataFrame) -> DataFrame:
    import public_tokenizers as P

    return pack(docs, P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of every document in windows, see `pack`; a text of any length is cut into windows, none is dropped."""
    return pack_public(table(spark, sf_dir, "documents"))
