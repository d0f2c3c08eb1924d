"""Bounded-space online packing of token documents into sequences, with a fixed number of open windows.

Every partition reads its documents once, in order, and keeps ``open_windows`` windows of
``size`` tokens open. A document goes into the fullest window that takes all of it (best
fit), or opens a window while fewer are open. Where none fits, the fullest window is
emitted and a new one takes its place: if documents may be cut, it is filled to the brim
first with the head of the document, whose rest is placed by the same rule; if not, it is
emitted with its gap.

What is open at the end of a partition is its leftovers, at most ``open_windows`` windows.
The leftovers of all partitions are dealt to groups of bounded size and merged: packed once
more by the same rule, longest first, and where documents may be cut, the windows that are
still open then are joined end to end and cut at every ``size`` tokens. The last tokens of
a group, fewer than ``size``, become sequences whose lengths are powers of two, which need no
padding. A task holds its open windows and one batch of texts, whatever its input.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from microveil.llm.shared import cut, scan_groups, small_batches
from microveil.llm.tokens import coder

PLACED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
FIELDS = [tuple(f.split()) for f in PLACED.split(", ")]
MERGED = 1 << 62  # from here on, numbers of sequences made of leftovers

Piece = tuple  # (doc_id, start, ids, doc_tokens)


class Windows:
    """Open windows; ``emit`` gets the pieces of every window that is closed."""

    def __init__(self, size: int, most: int, may_cut: bool, emit):
        self.size, self.most, self.may_cut, self.emit = size, most, may_cut, emit
        self.gaps: list[tuple[int, int]] = []  # (tokens free, window), smallest gap first
        self.held: dict[int, list[Piece]] = {}
        self.made = 0

    def _put(self, at: int | None, gap: int, piece: Piece) -> None:
        """Adds a piece to window ``at`` (None: a new one), which has ``gap`` tokens free."""
        if at is None:
            at, self.made = self.made, self.made + 1
            self.held[at] = []
        self.held[at].append(piece)
        gap -= len(piece[2])
        if gap:
            insort(self.gaps, (gap, at))
        else:
            self.emit(self.held.pop(at))

    def place(self, doc_id, start: int, ids: np.ndarray, doc_tokens: int) -> None:
        while len(ids) > self.size:  # a document over a window fills windows of its own first
            self.emit([(doc_id, start, ids[: self.size], doc_tokens)])
            start, ids = start + self.size, ids[self.size :]
        while len(ids):
            k = bisect_left(self.gaps, (len(ids), -1))
            if k < len(self.gaps):
                gap, at = self.gaps.pop(k)
                return self._put(at, gap, (doc_id, start, ids, doc_tokens))
            if len(self.gaps) < self.most:
                return self._put(None, self.size, (doc_id, start, ids, doc_tokens))
            gap, at = self.gaps.pop(0)
            if self.may_cut:
                self._put(at, gap, (doc_id, start, ids[:gap], doc_tokens))
                start, ids = start + gap, ids[gap:]
            else:
                self.emit(self.held.pop(at))

    def rest(self) -> list[list[Piece]]:
        """The windows that are still open, fullest first; none is open afterwards."""
        out = [self.held.pop(at) for _, at in self.gaps]
        self.gaps = []
        return out


class Rows:
    """Output rows of closed windows, in batches of bounded size."""

    def __init__(self, first_sequence: int, leftovers: bool):
        self.sequence, self.leftovers, self.rows = first_sequence, leftovers, []

    def closed(self, pieces: list[Piece]) -> None:
        offset = 0
        for doc_id, start, ids, total in pieces:
            self.rows.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes()), total, self.sequence, offset, None))
            offset += len(ids)
        self.sequence += 1

    def left(self, pieces: list[Piece]) -> None:
        for doc_id, start, ids, total in pieces:
            self.rows.append((doc_id, start, len(ids), None, total, None, None, ids.tobytes()))

    def taken(self, least: int = 0) -> Iterator[pa.RecordBatch]:
        if len(self.rows) > least:
            kept = FIELDS + ([("ids", "binary")] if self.leftovers else [])
            columns = list(zip(*self.rows, strict=True))
            arrays = [pa.array(columns[i], pa.binary() if t == "binary" else pa.int64()) for i, (_, t) in enumerate(kept)]
            yield pa.RecordBatch.from_arrays(arrays, names=[n for n, _ in kept])
            self.rows = []


def _online(batches, size: int, most: int, may_cut: bool, end_id: int, files: tuple):
    code = coder(*files)
    out = Rows(TaskContext.get().partitionId() << 32, True)
    windows = Windows(size, most, may_cut, out.closed)
    for b in batches:
        for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            ids = np.append(code.encode(text.as_py() or ""), np.uint32(end_id)).astype("<u4")
            if len(ids) > size and not may_cut:
                raise ValueError(f"a document of {len(ids)} tokens is over a window of {size}, and documents may not be cut")
            windows.place(doc_id, 0, ids, len(ids))
            yield from out.taken(20_000)
    for pieces in windows.rest():
        out.left(pieces)
    yield from out.taken()


def _joined(windows: list[list[Piece]], size: int, emit) -> None:
    """Cuts the pieces of ``windows``, end to end, at every ``size`` tokens; the last tokens go to sequences of powers of two."""
    total = sum(len(p[2]) for w in windows for p in w)
    lengths = [size] * (total // size) + [1 << k for k in range(size.bit_length(), -1, -1) if total % size >> k & 1]
    now, room = [], 0
    for doc_id, start, ids, all_ids in (p for w in windows for p in w):
        while len(ids):
            room = room or lengths.pop(0)
            part, ids = ids[:room], ids[room:]
            now.append((doc_id, start, part, all_ids))
            start, room = start + len(part), room - len(part)
            if not room:
                emit(now)
                now = []


def _merge(t: pa.Table, size: int, most: int, may_cut: bool):
    """Packs each whole group of leftovers, sorted by group and falling length."""
    g = t["g"].to_numpy()
    head = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1])))
    for lo, hi in zip(head, [*head[1:], len(g)], strict=True):
        out = Rows(MERGED + (int(g[lo]) << 32), False)
        windows = Windows(size, most, may_cut, out.closed)
        part = t.slice(lo, hi - lo)
        for r in zip(*[part[c].to_pylist() for c in ("doc_id", "start", "ids", "doc_tokens")], strict=True):
            windows.place(r[0], r[1], np.frombuffer(r[2], "<u4"), r[3])
        rest = windows.rest()
        if may_cut:
            _joined(rest, size, out.closed)
        else:
            for pieces in rest:
                out.closed(pieces)
        yield from out.taken()


def pack_online(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    size: int = 2048,
    end_id: int = 1,
    open_windows: int = 64,
    may_cut: bool = True,
    group_tokens: int = 1 << 20,
    files: tuple = (None, None),
) -> DataFrame:
    """One row a piece: doc_id, start (its document's ids before it), length, ids_crc32, doc_tokens, sequence_id, offset.

    A document's ids end with ``end_id``; a null text counts as empty and gives one piece of
    that id. Repeated and null ids are kept row by row; other columns are left aside. Equal
    gaps go to the window opened first. An empty table gives an empty result. With ``may_cut`` every
    sequence has ``size`` tokens or a power of two; without, a document over ``size`` tokens is an
    error. The number of sequences depends on how the table is dealt to partitions, by one
    ``group_tokens`` group of leftovers at most. The first pass is checkpointed, as
    finished pieces and leftovers are both read from it.
    """
    if size < 1 or open_windows < 1:
        raise ValueError("size and open_windows are at least 1")
    small_batches(docs.sparkSession)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    work = partial(_online, size=size, most=open_windows, may_cut=may_cut, end_id=end_id, files=files)
    first = cut(source.mapInArrow(work, f"{PLACED}, ids binary"))
    done, left = first.where("ids IS NULL").drop("ids"), first.where("ids IS NOT NULL")
    tokens = left.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    groups = max(1, -(-tokens // group_tokens))
    dealt = left.withColumn("g", F.pmod(F.xxhash64("doc_id", "start", F.monotonically_increasing_id()), F.lit(groups)))
    sorted_groups = dealt.repartition("g").sortWithinPartitions("g", F.desc("length"), "doc_id", "start")
    merge = partial(_merge, size=size, most=open_windows, may_cut=may_cut)
    return done.unionByName(sorted_groups.mapInArrow(lambda bs: scan_groups(bs, ["g"], merge, 1024), PLACED))
