"""Line deduplication by a segment-partition edit join.

A line goes when an earlier line of the corpus equals it or is within a few edits
(insert, delete or change a character) of it: one edit for every ``share`` characters of the
shorter line, ``tau`` at most. Lines are ordered by doc_id, then by
the document's hash, then by place, so the first occurrence of every text stays.

1. Exact: lines meet by 128-bit hash; the first occurrence is a partial aggregate.
2. Segments: if two lines are within tau edits, one of the tau + 1 segments of the
   shorter occurs in the longer, at a place that their lengths and the number of the
   segment narrow down. Each line posts its segments under (length, segment number,
   hash) and probes the lengths from its own down to tau less with the few substrings
   that can match. Hashes of all substrings come from one prefix sum.
3. A key under which very many lines meet (a segment that a whole family of lines has) is
   refined: with that segment cut out, what is left of two neighbours is within tau
   edits too, so its own segments make longer keys. What is still large is dealt out in blocks.
4. Lines that meet under some key are verified on their texts by banded
   bit-parallel edit distance, many pairs at a time; each line looks for one earlier
   neighbour only.
5. Each document keeps the lines that are first and have no earlier neighbour.

Texts are read again in each step and never collected; only ids and hashes move, then
the texts of lines that met, then the documents to be rewritten.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from microveil.llm import textscan as T
from microveil.llm.shared import cut, scan_groups, small_batches

#: Lines that meet in one block of a key, about; and distinct lines that a task remembers so as not to post them again.
BLOCK_LINES = 4096
#: Postings of one key that a task looks at together.
MOST = 1 << 20
REMEMBER = 1 << 20
BLOOM_BITS = 23


def lines_of(column: pa.Array):
    """Per chunk of texts: first row, code points, line starts and ends (in code points), index of each text's first line."""
    for first, last, data, off in T.chunks(column):
        head = (data & 0xC0) != 0x80
        at = np.concatenate(([0], np.cumsum(head)))[off]
        code = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), np.uint32)
        n = len(code)
        breaks = np.flatnonzero(code == 10)
        # one more "break" ends every text
        ends = np.concatenate((breaks, at[1:]))
        owner = np.concatenate((np.searchsorted(at, breaks, side="right") - 1, np.arange(last - first)))
        order = np.lexsort((ends, owner))
        ends, owner = ends[order], owner[order]
        text_first = np.searchsorted(owner, np.arange(last - first + 1))
        starts = np.empty(len(ends), np.int64)
        starts[1:] = ends[:-1] + 1
        starts[text_first[:-1]] = at[:-1]
        yield first, last, code, starts, np.minimum(ends, n), text_first


_codes: dict[int, np.ndarray] = {}


def values(code: np.ndarray, seed: int) -> np.ndarray:
    """A random 64-bit value for each code point: from a table for those below 65,536, computed for the others."""
    if seed not in _codes:
        _codes[seed] = T.mix(np.arange(1, (1 << 16) + 1, dtype=np.uint64) + np.uint64(seed))
    out = _codes[seed][code & 0xFFFF]
    far = np.flatnonzero(code >> 16)
    if len(far):
        out[far] = T.mix(code[far].astype(np.uint64) + np.uint64(seed + 1))
    return out


class Prefix:
    """Hash of any span of a code point array in constant time; ``seed`` gives independent hashes."""

    def __init__(self, code: np.ndarray, seed: int = 0):
        p, self.inverse = T.powers(len(code) + 1)
        self.total = np.zeros(len(code) + 1, np.uint64)
        product = values(code, seed)
        product *= p[:-1]
        np.cumsum(product, out=self.total[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return T.mix((self.total[end] - self.total[start]) * self.inverse[start] + (end - start).astype(np.uint64))


def _posted(code: np.ndarray, starts: np.ndarray, ends: np.ndarray, least: int) -> np.ndarray:
    """Which lines take part: long enough and not only white space."""
    take = ends - starts >= least
    if take.any():
        # most lines begin or end with more than white space; the others are looked at whole
        edge = lambda at: (code[at] > 32) & (code[at] != 0xA0)
        at = np.flatnonzero(take)
        at = at[~(edge(starts[at]) | edge(ends[at] - 1))]
        for i in at.tolist():
            part = code[starts[i] : ends[i]]
            take[i] = ((part > 32) & (part != 0xA0)).any()
    return take


def _occurrences(batches, least: int):
    for b in batches:
        ids, keys = b.column(0), b.column(1)
        for first, last, code, starts, ends, text_first in lines_of(b.column(2)):
            take = np.flatnonzero(_posted(code, starts, ends, least))
            if not len(take):
                continue
            row = np.searchsorted(text_first, take, side="right") - 1
            where = pa.array(row + first)
            one, two = Prefix(code)(starts[take], ends[take]), Prefix(code, 1 << 40)(starts[take], ends[take])
            yield pa.RecordBatch.from_arrays([ids.take(where), keys.take(where), pa.array((take - text_first[row]).astype(np.int32)), pa.array(one.astype(np.int64)), pa.array(two.astype(np.int64))], names=["id", "rk", "line", "h", "h2"])


def segments(length: np.ndarray, tau: int, i: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of segment i (from 0) of lines of these lengths: tau + 1 parts, the last ones a character longer."""
    short = length // (tau + 1)
    longer = length - short * (tau + 1)
    before = np.maximum(0, i - (tau + 1 - longer))
    return i * short + before, short + (i >= tau + 1 - longer)


def probes(tau: int) -> list[tuple[int, int, int, int]]:
    """(length difference, segment, first shift, last shift) where a segment of the shorter line can start in the longer, less where it starts in its own."""
    out = []
    for delta in range(tau + 1):
        for i in range(tau + 1):
            lo = max(-i, delta - (tau - i))
            hi = min(i, delta + (tau - i))
            if lo <= hi:
                out.append((delta, i, lo, hi))
    return out


def tight(lengths: np.ndarray, tau: int, share: int) -> np.ndarray:
    """Edits that a line of each length bears."""
    return np.minimum(tau, lengths // share)


def postings(h: Prefix, s: np.ndarray, n: np.ndarray, tau: int, share: int, deltas: np.ndarray | None = None):
    """(rows, keys, own, difference, segment starts, segment lengths) for spans at s of length n: their segments, and the places where those of shorter lines may be.

    With ``deltas`` each span looks for lines shorter by just so much, and those of 0 post their segments.
    """
    for delta, i, lo, hi in probes(tau):
        length = n - delta
        ok = length >= share if deltas is None else (deltas == delta) & (length >= 0)
        if not ok.any():
            continue
        p, size = segments(np.maximum(length, 0), tau, i)
        for shift in range(lo, hi + 1):
            a = s + p + shift
            fit = np.flatnonzero(ok & (p + shift >= 0) & (p + shift + size <= n))
            k = h(a[fit], (a + size)[fit])
            k = T.mix(k + (length[fit] * (tau + 1) + i).astype(np.uint64))
            yield fit, k & ~np.uint64(1), not delta and not shift, delta, a[fit], size[fit]


def _keys(batches, tau: int, share: int):
    """(key, line hash) for every line once a task, as far as it remembers; odd keys are segments of the line itself, even ones probes."""
    seen = np.zeros(0, np.uint64)
    for b in batches:
        for _, _, code, starts, ends, _ in lines_of(b.column(2)):
            take = np.flatnonzero(_posted(code, starts, ends, share))
            h = Prefix(code)
            name, at = np.unique(h(starts[take], ends[take]), return_index=True)
            new = ~np.isin(name, seen, assume_unique=True)
            name, take = name[new], take[at[new]]
            if len(seen) < REMEMBER:
                seen = np.union1d(seen, name)
            if not len(take):
                continue
            keys, names = [], []
            for fit, k, own, *_ in postings(h, starts[take], ends[take] - starts[take], tau, share):
                keys.append(k | np.uint64(own))
                names.append(name[fit])
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).astype(np.int64)), pa.array(np.concatenate(names).astype(np.int64))], names=["key", "h"])


def _refined(batches, tau: int, share: int):
    """(longer key, line hash) of lines that meet under a common key: segments of what is left without the one they share."""
    for b in batches:
        key, name = (b.column(j).to_numpy().astype(np.uint64) for j in (0, 1))
        texts = b.column(2).to_pylist()
        size = np.array([len(x) for x in texts])
        flat = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        begin = np.cumsum(size) - size
        rest, row, delta_of = [], [], []
        for fit, k, own, delta, a, n in postings(Prefix(flat), begin, size, tau, share):
            hit = np.flatnonzero(k == key[fit])
            for i, x, m in zip(fit[hit].tolist(), a[hit].tolist(), n[hit].tolist(), strict=True):
                rest.append(np.concatenate((flat[begin[i] : x], flat[x + m : begin[i] + size[i]])))
                row.append(i)
                delta_of.append(delta if delta or own else -1)
        if not rest:
            continue
        row, delta_of = np.array(row), np.array(delta_of)
        code, n = np.concatenate(rest), np.array([len(x) for x in rest])
        keys, names = [], []
        for fit, k, own, *_ in postings(Prefix(code), np.cumsum(n) - n, n, tau, share, np.maximum(delta_of, 0)):
            posts = own & (delta_of[fit] == 0)  # a line posts the rest of its own segment only
            keys.append(T.mix(k ^ key[row[fit]]) & ~np.uint64(1) | posts.astype(np.uint64))
            names.append(name[row[fit]])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).astype(np.int64)), pa.array(np.concatenate(names).astype(np.int64))], names=["key", "h"])


def _meetings(t: pa.Table, part: bool):
    """Keys that a segment and another line share, with the lines; all lines of a key that comes in parts."""
    key, h = t["key"].to_numpy(), t["h"].to_numpy()
    key, own = key & ~1, (key & 1).astype(bool)
    order = np.lexsort((~own, h, key))
    key, h, own = key[order], h[order], own[order]
    fresh = np.concatenate(([True], (key[1:] != key[:-1]) | (h[1:] != h[:-1])))
    key, h, own = key[fresh], h[fresh], own[fresh]  # one row for a line under a key; its own segment wins
    head = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    size = np.diff(np.concatenate((head, [len(key)])))
    keep = np.repeat(part | ((size > 1) & (np.add.reduceat(own.astype(np.int64), head) > 0)), size)
    if keep.any():
        yield pa.RecordBatch.from_arrays([pa.array(key[keep]), pa.array(h[keep]), pa.array(own[keep])], names=["key", "h", "own"])


def _texts(batches, least: int, bloom):
    """Texts of the lines whose hash may be among those that met; each once a task, as far as it remembers."""
    bits, seen = bloom.value, np.zeros(0, np.uint64)
    for b in batches:
        for _, _, code, starts, ends, _ in lines_of(b.column(2)):
            take = np.flatnonzero(_posted(code, starts, ends, least))
            name, at = np.unique(Prefix(code)(starts[take], ends[take]), return_index=True)
            slot = (name >> np.uint64(64 - BLOOM_BITS)).astype(np.int64)
            want = ((bits[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1).astype(bool) & ~np.isin(name, seen, assume_unique=True)
            name, take = name[want], take[at[want]]
            if len(seen) < REMEMBER:
                seen = np.union1d(seen, name)
            if len(take):
                yield pa.RecordBatch.from_arrays([pa.array(name.astype(np.int64)), pa.array([code[x:y].tobytes().decode("utf-32-le", "surrogatepass") for x, y in zip(starts[take], ends[take], strict=True)])], names=["h", "text"])


def _bits(batches):
    """One row: which hash slots occur, as bits."""
    bits = np.zeros(1 << BLOOM_BITS, bool)
    for b in batches:
        bits[(b.column(0).to_numpy().astype(np.uint64) >> np.uint64(64 - BLOOM_BITS)).astype(np.int64)] = True
    packed = np.packbits(bits, bitorder="little")
    rows = [(j, x.tobytes()) for j, x in enumerate(packed.reshape(64, -1)) if x.any()]
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array([j for j, _ in rows], pa.int32()), pa.array([x for _, x in rows], pa.binary())], names=["block", "bits"])


def _either(batches):
    total: dict[int, np.ndarray] = {}
    for b in batches:
        for j, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            part = np.frombuffer(x, np.uint8)
            total[j] = total[j] | part if j in total else part
    for j, x in total.items():
        yield pa.RecordBatch.from_arrays([pa.array([j], pa.int32()), pa.array([x.tobytes()], pa.binary())], names=["block", "bits"])


def within(flat: np.ndarray, a: np.ndarray, an: np.ndarray, b: np.ndarray, bn: np.ndarray, tau: int) -> np.ndarray:
    """Whether spans (a, length an) and (b, length bn) of ``flat`` are within tau edits; all pairs at once.

    The band of 2 tau + 1 diagonals is a bit vector per pair: bit d of the running
    vectors says whether the cell on that diagonal is one more or one less than its
    neighbour along the column, and each column costs a fixed number of word operations.
    """
    width = 2 * tau + 1
    out = np.zeros(len(a), bool)
    live = np.flatnonzero(np.abs(an - bn) <= tau)
    full = np.uint64((1 << width) - 1)
    one = np.uint64(1)
    # in column j, bit d is row j - tau + d; before the first, rows rise by one from row 0
    vp = np.full(len(live), ((1 << (tau + 1)) - 1) << tau, np.uint64)
    vn = np.zeros(len(live), np.uint64)
    score = np.full(len(live), tau, np.int64)  # of the lowest diagonal: row j + tau, at column 0
    pa_, la, pb, lb = a[live], an[live], b[live], bn[live]
    j = 0
    while len(live):
        done = lb == j
        if done.any():
            # walk up from the lowest band row to the last row of a
            k = np.flatnonzero(done)
            d, up = score[k].copy(), la[k] - j + tau  # band index of the last row
            for bit in range(2 * tau - 1, -1, -1):
                step = bit >= up
                d -= np.where(step, ((vp[k] >> np.uint64(bit)) & one).astype(np.int64) - ((vn[k] >> np.uint64(bit)) & one).astype(np.int64), 0)
            out[live[k]] = d <= tau
            go = ~done
            live, vp, vn, score, pa_, la, pb, lb = (x[go] for x in (live, vp, vn, score, pa_, la, pb, lb))
            if not len(live):
                break
        c = flat[pb + j]
        eq = np.zeros(len(live), np.uint64)
        for d in range(width):
            row = j - tau + d  # 0-based character of a on this diagonal, in the next column
            ok = (row >= 0) & (row < la)
            eq |= (ok & (flat[pa_ + np.clip(row, 0, la - 1)] == c)).astype(np.uint64) << np.uint64(d)
        x = eq | vn
        d0 = ((((eq & vp) + vp) ^ vp) | x) & full
        hp = vn | (~(d0 | vp) & full)
        hn = d0 & vp
        lowest = (d0 >> np.uint64(width - 1)) & one
        score = score + 1 - lowest.astype(np.int64)
        x = d0 >> one  # the band of the next column is one row lower
        vp, vn = hn | (~(x | hp) & full), hp & x
        j += 1
        if not j % 16:
            go = score - 2 * tau <= tau  # the lowest diagonal is at most 2 tau above the least cell
            if not go.all():
                live, vp, vn, score, pa_, la, pb, lb = (x[go] for x in (live, vp, vn, score, pa_, la, pb, lb))
    return out


def _near(t: pa.Table, tau: int, share: int):
    """Lines with an earlier line within tau edits among those that met."""
    key, ga, gb, c, own = (t[x].to_numpy() for x in ("key", "a", "b", "c", "own"))
    h, rank = t["h"].to_numpy(), np.array(list(zip(*(t[x].to_pylist() for x in ("id", "rk", "line")), strict=True)), dtype=[("i", "i8"), ("k", "i8"), ("l", "i8")])
    text = t["text"].combine_chunks().to_pylist()
    size = np.array([len(x) for x in text])
    flat = np.frombuffer("".join(text).encode("utf-32-le", "surrogatepass"), np.uint32)
    at = np.concatenate(([0], np.cumsum(size)))[:-1]
    place = np.empty(len(h), np.int64)
    place[np.argsort(rank, order=("i", "k", "l"), kind="stable")] = np.arange(len(h))
    head = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (ga[1:] != ga[:-1]) | (gb[1:] != gb[:-1]))))
    near: set[int] = set()
    tried: set[tuple[int, int]] = set()
    todo: list[tuple[np.ndarray, np.ndarray]] = []
    held = 0

    def verify():
        x, y = (np.concatenate(z) for z in zip(*todo, strict=True))
        todo.clear()
        fresh = [(p, q) not in tried for p, q in zip(h[x].tolist(), h[y].tolist(), strict=True)]
        x, y = x[fresh], y[fresh]
        if len(x):
            _, once = np.unique(np.stack((h[x], h[y])), axis=1, return_index=True)
            x, y = x[once], y[once]
            if len(tried) < 1 << 18:
                tried.update(zip(h[x].tolist(), h[y].tolist(), strict=True))
            bound = tight(np.minimum(size[x], size[y]), tau, share)
            for most in range(1, tau + 1):
                u, v = x[bound == most], y[bound == most]
                near.update(h[u[within(flat, at[u], size[u], at[v], size[v], most)]].tolist())

    for lo, hi in zip(head, [*head[1:], len(h)], strict=True):
        idx = np.arange(lo, hi)
        idx = idx[np.argsort(place[idx])]
        for i in range(1, len(idx)):
            x = idx[i]
            if h[x] in near:
                continue
            y = idx[:i]
            y = y[(own[y] | own[x]) & (np.abs(size[y] - size[x]) <= tight(np.minimum(size[y], size[x]), tau, share)) & (h[y] != h[x])]
            if ga[x] != gb[x]:
                y = y[c[y] != c[x]]
            if len(y):
                todo.append((np.full(len(y), x), y))
                held += len(y)
            if held >= 20_000:
                verify()
                held = 0
    if todo:
        verify()
    if near:
        # a line is known by 128 bits from here on, the second half from the text that was compared
        rows = np.flatnonzero(np.isin(h, sorted(near)))
        second = Prefix(flat, 1 << 40)(at[rows], at[rows] + size[rows])
        yield pa.RecordBatch.from_arrays([pa.array(h[rows]), pa.array(second.astype(np.int64))], names=["h", "h2"])


BLANK = "".join(map(chr, range(33))) + "\xa0"


def _rewritten(batches, least: int):
    for b in batches:
        text_out, lines, dropped = [], [], []
        for raw, mine in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            parts = (raw or "").split("\n")
            kept = set(mine or ())
            stay = [x for i, x in enumerate(parts) if i in kept or len(x) < least or not x.strip(BLANK)]
            lines.append(len(parts))
            dropped.append(len(parts) - len(stay))
            text_out.append("\n".join(stay) if dropped[-1] else raw)
        rest = [b.column(j) for j in range(2, b.num_columns)]
        yield pa.RecordBatch.from_arrays([pa.array(text_out, pa.string()), pa.array(lines, pa.int32()), pa.array(dropped, pa.int32()), *rest], names=["_text", "n_lines", "n_dropped", *b.schema.names[2:]])


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tau: int = 2, share: int = 8, least: int = 1) -> DataFrame:
    """``docs`` with the text rewritten, and ``n_lines`` and ``n_dropped`` (columns of these names are replaced).

    Lines are what ``\\n`` separates. Lines of white space only always stay, as do lines of fewer
    than ``least`` characters. A line that equals no earlier one goes for one within as many edits
    as there are ``share`` characters in the shorter of the two, ``tau`` at most (so lines of
    fewer than 8 characters only for equal ones). A null text stays null; an empty text has one empty line.
    Rows that repeat an id and a text count as one document and are treated alike; a null
    id comes before all others. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    small_batches(spark)
    base = docs.drop("n_lines", "n_dropped")
    source = base.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("id"), F.xxhash64(F.col(text_col).cast("string"), F.col(id_col)).alias("rk"), F.col(text_col).cast("string").alias("text"))
    found = source.mapInArrow(partial(_occurrences, least=least), "id long, rk long, line int, h long, h2 long")
    firsts = cut(found.groupBy("h", "h2").agg(F.min(F.struct("id", "rk", "line")).alias("f")).select("h", "h2", "f.id", "f.rk", "f.line"))

    def meetings(keys: DataFrame) -> DataFrame:
        # one of each pair of keys is odd: both halves go to one partition, and sorted they adjoin
        halves = keys.repartition(F.shiftright("key", 1)).sortWithinPartitions("key")
        return cut(halves.mapInArrow(lambda bs: scan_groups(bs, ["key"], _meetings, 65536, lambda k: k >> 1, MOST), "key long, h long, own boolean"))

    met = meetings(source.mapInArrow(partial(_keys, tau=tau, share=share), "key long, h long"))
    bits = np.zeros((64, (1 << BLOOM_BITS) // 512), np.uint8)  # fixed size, whatever the corpus
    for r in met.select("h").mapInArrow(_bits, "block int, bits binary").repartition("block").mapInArrow(_either, "block int, bits binary").collect():
        bits[r["block"]] = np.frombuffer(r["bits"], np.uint8)
    bloom = spark.sparkContext.broadcast(bits.reshape(-1))
    texts = source.mapInArrow(partial(_texts, least=share, bloom=bloom), "h long, text string").groupBy("h").agg(F.min("text").alias("text"))
    sized = lambda rows: rows.groupBy("key").agg(F.ceil(F.count("*") / F.lit(BLOCK_LINES)).cast("int").alias("g"))
    common = cut(sized(met).where("g > 1").select("key"))
    if not common.isEmpty():
        texts = cut(texts)
        again = met.join(common, "key").select("key", "h").join(texts, "h").select("key", "h", "text").mapInArrow(partial(_refined, tau=tau, share=share), "key long, h long")
        met = met.join(common, "key", "left_anti").unionByName(meetings(again))
    place = firsts.groupBy("h").agg(F.min(F.struct("id", "rk", "line")).alias("f")).select("h", "f.*")
    dealt = met.join(sized(met), "key").withColumn("c", F.pmod(F.xxhash64("h"), "g").cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("g") - 1)))
    dealt = dealt.select("key", F.least("c", "o").alias("a"), F.greatest("c", "o").alias("b"), "c", "h", "own").join(place.join(texts, "h"), "h")
    near = dealt.repartition("key", "a", "b").sortWithinPartitions("key", "a", "b").mapInArrow(lambda bs: scan_groups(bs, ["key", "a", "b"], partial(_near, tau=tau, share=share), 4096), "h long, h2 long").distinct()
    kept = firsts.join(near, ["h", "h2"], "left_anti").groupBy("id", "rk").agg(F.collect_list("line").alias("kept"))

    shape = base.schema
    names = [f"_c{i}" for i in range(len(shape))]
    plain = base.toDF(*names)
    idx = {f.name: i for i, f in enumerate(shape)}
    whole = plain.withColumns({"_id": F.coalesce(F.col(names[idx[id_col]]).cast("long"), F.lit(-(1 << 63))), "_rk": F.xxhash64(F.col(names[idx[text_col]]).cast("string"), F.col(names[idx[id_col]]))})
    kept = kept.select(F.col("id").alias("_id"), F.col("rk").alias("_rk"), F.col("kept").alias("_kept"))
    rest = [c for i, c in enumerate(names) if i != idx[text_col]]
    rows = whole.join(kept, ["_id", "_rk"], "left").select(F.col(names[idx[text_col]]).cast("string").alias("_text"), "_kept", *rest)
    fields = ", ".join(f"{names[i]} {f.dataType.simpleString()}" for i, f in enumerate(shape) if i != idx[text_col])
    out = rows.mapInArrow(partial(_rewritten, least=least), "_text string, n_lines int, n_dropped int" + (f", {fields}" if fields else ""))
    return out.select(*[F.col("_text" if i == idx[text_col] else names[i]).alias(f.name) for i, f in enumerate(shape)], "n_lines", "n_dropped")
