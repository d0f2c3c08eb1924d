"""Best-fit packing of token pieces under several capacities at once.

A sequence has three capacities: tokens, documents, and attention cost (the sum of
squared piece lengths). Pieces are placed in decreasing length; of the open
sequences that can take a piece under every capacity, the one is chosen whose
residual vector, as shares of the capacities, has the largest weighted dot product
with the piece's vector (rule "dot") or the smallest weighted norm once it is
placed (rule "norm"). A piece that fits nowhere opens a sequence.

Pieces are dealt to groups of about ``group_rows`` by their row, whatever their ids; each
group is packed on its own in bounded memory, at the cost of at most about one
part-filled sequence a group.
"""

from __future__ import annotations

import zlib
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from microveil.llm.shared import cut, numbered, scan_groups, small_batches
from microveil.llm.tokens import coder

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _cut_ids(batches, size: int, end_id: int, files: tuple):
    code = coder(*files)
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    for b in batches:
        rows = []
        for i, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            ids = np.append(code.encode(text.as_py() or ""), np.uint32(end_id)).astype("<u4")
            first = len(ids) % size or size
            edges = [0, *range(first, len(ids) + 1, size)]
            for j, (x, y) in enumerate(zip(edges, edges[1:], strict=False)):
                rows.append((i, j, x, y - x, zlib.crc32(ids[x:y].tobytes())))
            if len(rows) >= 50_000:
                yield batch(rows)
                rows = []
        if rows:
            yield batch(rows)


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 1024, end_id: int = 2, files: tuple = (None, None)) -> DataFrame:
    """Token pieces of every text: doc_id, piece, start, length, ids_crc32.

    A text's ids end with ``end_id``. Only a text of more than ``size`` ids is cut,
    into pieces of ``size`` of which the first holds the remainder. A null text counts
    as empty and gives one piece. Repeated and null ids are kept row by row.
    """
    small_batches(docs.sparkSession)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(partial(_cut_ids, size=size, end_id=end_id, files=files), PIECES)


def best_fit(lengths: np.ndarray, capacity: tuple[float, float, float], weights: tuple[float, float, float], rule: str) -> tuple[np.ndarray, np.ndarray, int]:
    """Sequence and offset of each piece, and the number of sequences.

    Pieces that are equally long are taken in their order; ties between sequences go
    to the one opened first.
    """
    tokens, docs, cost = capacity
    w = np.array(weights) ** 2 if rule == "norm" else np.array(weights)
    order = np.argsort(-lengths, kind="stable")
    seq, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    smallest = lengths.min() if len(lengths) else 0
    res = np.zeros((3, max(16, len(lengths))))
    name = np.zeros(res.shape[1], np.int64)
    n = made = dead = 0
    for at in order:
        x = lengths[at]
        need = np.array([x, 1.0, float(x) * x])
        if need[0] > tokens or need[1] > docs or need[2] > cost:
            raise ValueError(f"a piece of {x} tokens is over a capacity")
        t, d, c = res[:, :n]
        fits = np.flatnonzero((t >= x) & (d >= 1) & (c >= need[2]))
        if len(fits):
            r = res[:, fits]
            if rule == "dot":
                score = -(w[0] * need[0] / tokens**2 * r[0] + w[1] / docs**2 * r[1] + w[2] * need[2] / cost**2 * r[2])
            else:
                score = w[0] * ((r[0] - x) / tokens) ** 2 + w[1] * ((r[1] - 1) / docs) ** 2 + w[2] * ((r[2] - need[2]) / cost) ** 2
            j = fits[int(score.argmin())]
        else:
            j, n = n, n + 1
            res[:, j], name[j] = (tokens, docs, cost), made
            made += 1
        seq[at], offset[at] = name[j], tokens - res[0, j]
        res[:, j] -= need
        dead += res[0, j] < smallest or res[1, j] < 1
        if dead > 256:  # what can take no piece any more leaves the search
            keep = (res[0, :n] >= smallest) & (res[1, :n] >= 1)
            m = int(keep.sum())
            res[:, :m], name[:m] = res[:, :n][:, keep], name[:n][keep]
            n, dead = m, 0
    return seq, offset, made


def _packed(t: pa.Table, length: str, capacity: tuple, weights: tuple, rule: str):
    """Packs each whole group of a table that is sorted by group."""
    g = t["g"].to_numpy()
    if t[length].null_count:
        raise ValueError("a piece without a length")
    size = t[length].to_numpy()
    if len(size) and size.min() < 0:
        raise ValueError("a piece of negative length")
    head = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1])))
    seq, offset = np.empty(len(g), np.int64), np.empty(len(g), np.int64)
    for lo, hi in zip(head, [*head[1:], len(g)], strict=True):
        seq[lo:hi], offset[lo:hi], _ = best_fit(size[lo:hi].astype(np.int64), capacity, weights, rule)
        seq[lo:hi] += g[lo] << 32
    out = t.drop_columns(["g"]).append_column("sequence_id", pa.array(seq)).append_column("offset", pa.array(offset))
    yield from out.to_batches()


def pack(items: DataFrame, keys: list[str], length_col: str = "length", max_tokens: int = 1024, max_docs: int = 1024, max_cost: int | None = None, weights: tuple = (1.0, 0.01, 0.01), rule: str = "norm", group_rows: int = 4096) -> DataFrame:
    """``items`` with ``sequence_id`` and ``offset`` (place in it, gapless from 0).

    ``items`` is cut (checkpointed) first, as it is counted and then packed; rows are dealt to
    groups by their number in that copy, so null, repeated or common ids don't gather. ``keys``
    order equally long pieces of a group. A null or negative length is an error; an empty
    table gives an empty result. Columns called sequence_id or offset are replaced.
    """
    kept = items.drop("sequence_id", "offset")
    base, length, *order = numbered(kept, length_col, *keys)
    base = cut(base)
    groups = max(1, -(-base.count() // group_rows))
    capacity = (float(max_tokens), float(max_docs), float(max_cost if max_cost is not None else max_tokens**2))
    dealt = base.withColumn("g", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)))
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in base.schema)
    work = partial(_packed, length=length, capacity=capacity, weights=weights, rule=rule)
    out = dealt.repartition("g").sortWithinPartitions("g", *order).mapInArrow(lambda bs: scan_groups(bs, ["g"], work, 1024), f"{fields}, sequence_id long, offset long")
    return out.toDF(*kept.columns, "sequence_id", "offset")
