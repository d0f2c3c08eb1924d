"""N-gram Jaccard join with adaptive multi-match prefixes.

A document's set is its distinct word shingles; two documents link when their
sets' Jaccard similarity reaches the threshold. All comparisons are exact.

How it stays linear-ish and whole:

1. One pass over the texts gives each document its set size and a 128-bit
   signature of its set, and each task a counting sketch of the shingles
   it meets again (fixed size, one slot per hash prefix) whose sum orders shingles from rare to
   common. Documents with equal sets collapse to their smallest id, by partial
   aggregation, so a hot group of copies is one document from then on.
2. A second pass emits every representative's prefix in that order. The base
   prefix must share one shingle with every partner; a prefix longer by l - 1
   must share l of them. l is chosen per document where the estimated candidate
   cost (sum of sketched frequencies) falls. A pair needs the smaller l of both.
   In close joins (0.85 or more) shingles are posted by size class (powers of two), as sets
   that differ much in size can't link.
3. Shingles in one prefix only are gone after a partial aggregation; each other
   shingle gets a pivot, the smallest document that has it.
4. Where many documents share much of their prefixes with one pivot, each is compared with that
   document first. If they link, it takes the pivot's label: documents of one label
   are connected already and need not meet. So a large group of near copies costs one
   comparison each, not all its pairs.
5. Documents of different labels meet at their pivots carrying their prefixes, so a
   pair's matches are counted in one place and no row per pair and shingle is made. Candidates
   come from a document's rarest shingles there, all but as many as a partner may miss; the
   common ones, as those of a template, are only looked up for candidates. A
   pivot with much weight is dealt out in blocks: those with its own label meet only the
   others, the others each other as well.
6. Pairs that pass the match count, the length filter and the bound that
   unmatched prefix shingles put on the overlap are verified on whole texts;
   pairs already connected inside their block are skipped.
7. Components of the links, then of the copies.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from microveil.llm import textscan as T
from microveil.llm.shared import components, cut, scan_groups, small_batches

SLOT_BITS = 20
BLOCKS = 256
SEEN_BITS = 25
#: Shingles of the documents that meet in one block of a pivot, about.
BLOCK_SHINGLES = 500_000
#: Documents that are compared with their pivot at once, and how many there must be for it to pay; fewer just meet each other.
STAR, FAMILY = 256, 32
#: Up to so many postings of a document's shingles are counted at once; with more, common shingles are only looked up for candidates.
FEW_POSTINGS = 20_000
#: Chunks of documents with the pivot's label are numbered from here.
MAIN = 1 << 20
#: From this similarity (in hundredths) on prefixes are short: posting by size class then costs little and saves meetings.
CLOSE = 85
#: For close and for other joins: l is at least this, or the size of the set over the second if that is more, and never more
#: than partners share; the third is what a posting costs (shuffled, sorted and stored) against a token of a set that is read.
#: Prefixes of other joins are long already, and a posting more costs them the most disk.
CLOSE_L, OTHER_L = (12, 32, 2), (6, 1 << 30, 16)
SLOTS = 1 << 19
#: Parts in which the copies of one set are looked up.
SALTS = 16


def sets_of(column: pa.Array, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """Row number and sorted distinct shingle hashes of every text."""
    for first, last, data, off in T.chunks(column):
        start, end, at = T.words(data, off)
        got, at = T.shingles(T.span_hashes(data, start, end), at, k)
        for i in range(last - first):
            yield first + i, np.unique(got[at[i] : at[i + 1]])


def signature(s: np.ndarray) -> tuple[int, int]:
    """Two sums over the set, as signed 64-bit integers."""
    one = T.mix(s ^ np.uint64(0xA5A5A5A55A5A5A5A)).sum(dtype=np.uint64)
    two = T.mix(s + np.uint64(0x1234567890ABCDEF)).sum(dtype=np.uint64)
    return int(one.astype(np.int64)), int(two.astype(np.int64))


def _profile(k: int):
    names = ["id", "n", "s1", "s2", "block", "counts"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]

    def run(batches):
        slots = np.zeros(1 << SLOT_BITS, np.int64)
        met = np.zeros(1 << SEEN_BITS, bool)
        for b in batches:
            n, one, two = [], [], []
            for _, s in sets_of(b.column(1), k):
                x, y = signature(s)
                n.append(len(s))
                one.append(x)
                two.append(y)
                # what the task sees for the first time is rare as far as it knows, and would only blur the counts of the rest
                place = (s & np.uint64((1 << SEEN_BITS) - 1)).astype(np.int64)
                again = s[met[place]]
                met[place] = True
                np.add.at(slots, (again >> np.uint64(64 - SLOT_BITS)).astype(np.int64), 1)
            if n:
                yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.nulls(len(n), pa.int32()), pa.nulls(len(n), pa.binary())], names=names)
        rows = [(j, zlib.compress(part.tobytes(), 1)) for j, part in enumerate(slots.reshape(BLOCKS, -1)) if part.any()]
        if rows:
            yield pa.RecordBatch.from_arrays([*[pa.nulls(len(rows), t) for t in kinds[:4]], pa.array([j for j, _ in rows], pa.int32()), pa.array([x for _, x in rows], pa.binary())], names=names)

    return run


def _add_counts(batches):
    total: dict[int, np.ndarray] = {}
    for b in batches:
        for j, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            part = np.frombuffer(zlib.decompress(x), np.int64)
            total[j] = total[j] + part if j in total else part
    for j, x in total.items():
        yield pa.RecordBatch.from_arrays([pa.array([j], pa.int32()), pa.array([x.tobytes()], pa.binary())], names=["block", "counts"])


def _needed(n: int, percent: int) -> int:
    """Of n shingles, so many at least are shared with any partner."""
    return -(-percent * n // 100)


def _sql_needed(n: str, percent: int) -> str:
    return f"(({percent} * {n} + 99) div 100)"


def _prefixes(k: int, percent: int, ranks, base: float):
    names = ["id", "n", "l", "size", "last", "prefix"]

    least_l, part, weight = CLOSE_L if percent >= CLOSE else OTHER_L

    def run(batches):
        rank = ranks.value
        for b in batches:
            out: list[list] = [[], [], [], [], [], []]
            ids = b.column(0).to_pylist()
            for i, s in sets_of(b.column(1), k):
                n = len(s)
                if not n:
                    continue
                r = rank[(s >> np.uint64(64 - SLOT_BITS)).astype(np.int64)]
                key = np.sort((r.astype(np.uint64) << np.uint64(56)) | (s & np.uint64((1 << 56) - 1)))
                need = _needed(n, percent)
                short = n - need
                least = min(max(least_l, n // part), need)
                load = np.maximum(1.0, 2.0 ** ((key >> np.uint64(56)).astype(float) / 2) - base).cumsum()[short:]
                # every posting is shuffled and looked at; of those that match l times the whole sets are read
                cost = weight * load + load / np.arange(1, need + 1) * (0.05 * n)
                l = int(cost[least - 1 :].argmin()) + least
                size = short + l
                # partners are about as large, so a shingle is posted by size class: the set's own, and those of smaller partners
                posted = [T.mix(key[:size] + np.uint64(c * 0x9E3779B97F4A7C15 & T.MASK)) for c in (range(need.bit_length(), n.bit_length() + 1) if percent >= CLOSE else (0,))]
                for col, v in zip(out, (ids[i], n, l, size, int(key[size - 1]), np.concatenate(posted).astype(np.int64)), strict=True):
                    col.append(v)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int32()), pa.array(out[3], pa.int32()), pa.array(out[4], pa.int64()), pa.array(out[5], pa.list_(pa.int64()))], names=names)

    return run


def _starred(k: int, percent: int):
    """Links of documents with the pivot of their group; whole groups."""

    def work(t: pa.Table):
        p, c, ids, want, own = (t[x].to_numpy(zero_copy_only=False) for x in ("p", "c", "id", "s1", "own"))
        head = np.flatnonzero(np.concatenate(([True], (p[1:] != p[:-1]) | (c[1:] != c[:-1]))))
        found: list[tuple[int, int]] = []
        for lo, hi in zip(head, [*head[1:], len(p)], strict=True):
            sets = {}
            for i, s in sets_of(t["text"].slice(lo, hi - lo).combine_chunks(), k):
                if signature(s)[0] == want[lo + i]:  # of repeated ids, the row that the set is from
                    sets[int(ids[lo + i]), bool(own[lo + i])] = s
            middle = sets.get((int(p[lo]), True))
            if middle is None:
                continue
            for (x, is_pivot), s in sets.items():
                if not is_pivot:
                    both = len(np.intersect1d(middle, s, assume_unique=True))
                    if 100 * both >= percent * (len(middle) + len(s) - both):
                        found.append((x, int(p[lo])))
        if found:
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], names=["a", "b"])

    return work


def _surviving(percent: int):
    """Per document of a block: the documents of other labels before it that it may link with."""

    def work(t: pa.Table):
        p, a, b, c = (t[x].to_numpy() for x in ("p", "a", "b", "c"))
        n, l, few, size, last, ids, label = (t[x].to_numpy() for x in ("n", "l", "few", "size", "last", "id", "label"))
        group = np.concatenate(([0], np.cumsum((p[1:] != p[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1]))))
        order = np.lexsort((ids, n, label, group))
        tokens, at_pivot, names = (t[x].combine_chunks() for x in ("tokens", "at", "pivots"))
        off = tokens.offsets.to_numpy()
        counts = np.diff(off)
        flat = tokens.values.to_numpy()[off[0] : off[-1]]
        # a shingle is known by 32 bits of its key and by its pivot; a chance match of both only adds a candidate
        to = names.values.to_numpy()[np.repeat(names.offsets.to_numpy()[:-1], counts) + at_pivot.values.to_numpy()[at_pivot.offsets[0].as_py() : at_pivot.offsets[-1].as_py()] - 1]
        where = np.empty(len(ids), np.int64)
        where[order] = np.arange(len(ids))
        event_row, event_group = np.repeat(where, counts), np.repeat(group, counts)
        run = np.lexsort((event_row, to, flat, event_group))
        rows, to_run = event_row[run], to[run]
        fresh = np.concatenate(([True], (flat[run][1:] != flat[run][:-1]) | (to_run[1:] != to_run[:-1]) | (event_group[run][1:] != event_group[run][:-1]))) if len(run) else np.zeros(0, bool)
        label_o = label[order]
        other = fresh.copy()
        other[1:] |= label_o[rows[1:]] != label_o[rows[:-1]]
        # of each event, where the shingle begins and where those of its own label begin
        begin = np.maximum.accumulate(np.where(fresh, np.arange(len(run)), 0))
        mine = np.maximum.accumulate(np.where(other, np.arange(len(run)), 0))
        place = np.empty(len(run), np.int64)
        place[run] = np.arange(len(run))
        starts = off - off[0]
        n_o, l_o, few_o, size_o, last_o, c_o, ids_o = n[order], l[order], few[order], size[order], last[order], c[order], ids[order]
        cross = (a != b)[order]
        partners: dict[int, np.ndarray] = {}
        named = np.zeros(len(ids), bool)
        for i, orig in enumerate(order):
            at = place[starts[orig] : starts[orig + 1]]
            long = mine[at] - begin[at]
            # a partner shares few_o[i] of these shingles, so one at least of all but the few_o[i] - 1 that most others have
            turn = np.argsort(long, kind="stable")
            at, long = at[turn], long[turn]
            rare = max(1, len(at) - int(few_o[i]) + 1) if long.sum() > FEW_POSTINGS else len(at)
            total = int(long[:rare].sum())
            if not total:
                continue
            spot = np.repeat(begin[at[:rare]] - np.cumsum(long[:rare]) + long[:rare], long[:rare]) + np.arange(total)
            js, which, hits = np.unique(rows[spot], return_inverse=True, return_counts=True)
            low = np.full(len(js), np.iinfo(np.int64).max)
            np.minimum.at(low, which, np.repeat(to_run[at[:rare]], long[:rare]))
            for x, size_x in zip(at[rare:], long[rare:], strict=True):  # of the common ones, only who is a candidate
                if size_x:
                    others = rows[begin[x] : begin[x] + size_x]
                    where_x = np.searchsorted(others, js)
                    have = others[np.minimum(where_x, size_x - 1)] == js
                    hits += have
                    low = np.where(have, np.minimum(low, to_run[x]), low)
            small, large = np.minimum(n_o[js], n_o[i]), np.maximum(n_o[js], n_o[i])
            left = np.where(last_o[js] <= last_o[i], n_o[js] - size_o[js], n_o[i] - size_o[i])
            ok = (100 * small >= percent * large) & (hits >= np.minimum(l_o[js], l_o[i])) & ((100 + percent) * (hits + left) >= percent * (small + large))
            ok &= low == p[orig]  # met at several pivots: counts at the smallest
            if cross[i]:
                ok &= c_o[js] != c_o[i]
            if ok.any():
                partners[i] = ids_o[js[ok]]
                named[js[ok]] = named[i] = True
        rows_out = np.flatnonzero(named)
        if len(rows_out):
            src = order[rows_out]
            none = np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(p[src]), pa.array(a[src]), pa.array(b[src]), pa.array(ids_o[rows_out]), pa.array(label_o[rows_out]), pa.array([partners.get(i, none) for i in rows_out.tolist()], pa.list_(pa.int64()))],
                names=["p", "a", "b", "id", "label", "partners"],
            )

    return work


def _verified(k: int, percent: int):
    def work(t: pa.Table):
        found: list[tuple[int, int]] = []
        keys = list(zip(*(t[x].to_pylist() for x in ("p", "a", "b")), strict=True))
        ids, want, text, partners, labels = t["id"].to_pylist(), t["s1"].to_pylist(), t["text"], t["partners"].to_pylist(), t["label"].to_pylist()
        edge = [i for i in range(len(keys)) if not i or keys[i] != keys[i - 1]] + [len(keys)]
        for lo, hi in zip(edge, edge[1:], strict=False):
            sets, need, label = {}, {}, {}
            for i, s in sets_of(text.slice(lo, hi - lo).combine_chunks(), k):
                if ids[lo + i] not in sets and signature(s)[0] == want[lo + i]:  # of repeated ids, the row that the set is from
                    sets[ids[lo + i]] = s
                    need[ids[lo + i]] = partners[lo + i]
                    label[ids[lo + i]] = labels[lo + i]
            names = sorted(sets)
            local = {x: j for j, x in enumerate(names)}
            vocabulary, codes = np.unique(np.concatenate([sets[x] for x in names]) if names else np.zeros(0, np.uint64), return_inverse=True)
            size = np.array([len(sets[x]) for x in names])
            at = np.concatenate(([0], np.cumsum(size)))
            mark = np.zeros(len(vocabulary), np.int64)
            first: dict[int, int] = {}
            root = [first.setdefault(label[x], j) for j, x in enumerate(names)]  # what one label has is connected

            def top(x: int, root=root) -> int:
                while root[x] != x:
                    root[x] = root[root[x]]
                    x = root[x]
                return x

            for i, x in enumerate(names):
                js = [j for y in need[x] if (j := local.get(y)) is not None and top(j) != top(i)]
                if not js:
                    continue
                mark[codes[at[i] : at[i + 1]]] = 1
                for j in js:
                    if top(j) == top(i):
                        continue
                    both = int(mark[codes[at[j] : at[j + 1]]].sum())
                    if 100 * both >= percent * (size[i] + size[j] - both):
                        root[top(j)] = top(i)
                        found.append((x, names[j]))
                mark[codes[at[i] : at[i + 1]]] = 0
        if found:
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], names=["a", "b"])

    return work


def link(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: ``doc_id``, ``n_shingles``, ``component_id``.

    ``percent`` is the least Jaccard similarity in hundredths, ``k`` the words of a
    shingle. Words are runs of bytes other than white space, A-Z in lower case. A
    null text counts as empty; texts without words link with nothing. Rows with a
    null id are left out, as nothing could refer to them. Of rows that repeat an id,
    the one with the smallest set counts (ties: smallest signature). Other columns
    are ignored. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    small_batches(spark)
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where("id IS NOT NULL")
    both = cut(source.mapInArrow(_profile(k), "id long, n long, s1 long, s2 long, block int, counts binary"))
    profile = both.where("block IS NULL").groupBy("id").agg(F.min(F.struct("n", "s1", "s2")).alias("s")).select("id", "s.*")
    counts = both.where("block IS NOT NULL").select("block", "counts").repartition("block").mapInArrow(_add_counts, "block int, counts binary").collect()
    slot = np.zeros((BLOCKS, (1 << SLOT_BITS) // BLOCKS), np.int64)  # fixed size, whatever the corpus
    for r in counts:
        slot[r["block"]] = np.frombuffer(r["counts"], np.int64)
    slot = slot.reshape(-1)
    ranks = spark.sparkContext.broadcast((2 * np.log2(np.maximum(slot, 1))).astype(np.uint8))
    copies = profile.where("n > 0").groupBy("n", "s1", "s2").agg(F.min("id").alias("rep"), F.count("*").alias("copies"))
    prefix = source.mapInArrow(_prefixes(k, percent, ranks, float(np.median(slot))), "id long, n long, l int, size int, last long, prefix array<long>")
    reps = copies.select(F.col("rep").alias("id"), "n", "s1")
    prefix = cut(prefix.join(reps, ["id", "n"]).dropDuplicates(["id"]))

    tokens = prefix.select("id", F.explode("prefix").alias("token"))
    shared = tokens.groupBy("token").agg(F.count("*").alias("m"), F.min("id").alias("p")).where("m > 1").select("token", "p")
    mine = tokens.join(shared, "token").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("token", "p"))).alias("x"))
    mine = cut(mine.join(prefix.drop("prefix"), "id"))
    mine = mine.withColumn("pivots", F.array_sort(F.array_distinct("x.p"))).withColumns({"tokens": F.expr("transform(x.token, y -> hash(y))"), "at": F.expr("transform(x.p, y -> cast(array_position(pivots, y) as int))")})
    # the matches of a pair that meets at its smallest common pivot p have pivots of p or more, and no partner asks for fewer than this
    smallest = _sql_needed("n", percent)
    least_l, part, _ = CLOSE_L if percent >= CLOSE else OTHER_L
    fewest = F.expr(f"least(l, greatest({least_l}, {smallest} div {part}), {_sql_needed(smallest, percent)})")
    mine = mine.withColumn("few", fewest)

    def texts(rows: DataFrame) -> DataFrame:
        # most texts meet nothing: what has no id in a slot of theirs isn't shuffled (SLOTS rows at most are broadcast)
        slots = rows.select(F.pmod(F.xxhash64("id"), F.lit(SLOTS)).alias("slot")).distinct()
        wanted = source.join(F.broadcast(slots), F.pmod(F.xxhash64("id"), F.lit(SLOTS)) == F.col("slot"), "left_semi")
        return rows.join(wanted, "id")

    most = F.array_max(F.expr("transform(pivots, p -> struct(size(filter(x.p, y -> y = p)) as c, -p as m))"))
    near = mine.select("id", "s1", "few", most.alias("m")).where("m.c >= few AND -m.m <> id").select(F.expr("-m.m").alias("p"), "id", "s1")
    near = cut(near)
    spread = near.groupBy("p").agg(F.count("*").alias("m")).where(F.col("m") >= FAMILY).select("p", F.ceil(F.col("m") / F.lit(STAR)).cast("int").alias("g"))
    around = near.join(spread, "p").select("p", F.pmod(F.xxhash64("id"), "g").cast("int").alias("c"), "id", "s1", F.lit(False).alias("own"))
    middle = spread.select("p", F.explode(F.sequence(F.lit(0), F.col("g") - 1)).alias("c"), F.col("p").alias("id")).join(reps.select("id", "s1"), "id").select("p", "c", "id", "s1", F.lit(True).alias("own"))
    stars = texts(around.unionByName(middle)).repartition("p", "c").sortWithinPartitions("p", "c")
    stars = cut(stars.mapInArrow(lambda bs: scan_groups(bs, ["p", "c"], _starred(k, percent), 512), "a long, b long"))

    mine = mine.join(stars.select(F.col("a").alias("id"), F.col("b").alias("label")), "id", "left").withColumn("label", F.coalesce("label", "id"))
    met = mine.withColumn("p", F.explode(F.expr("filter(pivots, p -> size(filter(x.p, y -> y >= p)) >= few)")))
    own, load = F.col("label") == F.col("p"), F.col("n") + F.size("tokens")
    blocks = lambda w: F.ceil(F.sum(w) / F.lit(BLOCK_SHINGLES)).cast("int")
    weight = met.groupBy("p").agg(F.min("label").alias("x"), F.max("label").alias("y"), blocks(load).alias("g"), blocks(F.when(own, load).otherwise(0)).alias("gm"), blocks(F.when(own, 0).otherwise(load)).alias("go")).where("x <> y").drop("x", "y")
    met = met.join(weight, "p").withColumn("h", F.xxhash64("id"))
    chunk = F.when(F.col("g") == 1, 0).when(own, F.lit(MAIN) + F.pmod("h", "gm")).otherwise(F.pmod("h", "go")).cast("int")
    theirs = F.when(F.col("g") == 1, F.array(F.lit(0))).when(own, F.expr("sequence(0, go - 1)")).otherwise(F.expr(f"concat(sequence(0, go - 1), transform(if(gm > 0, sequence(0, gm - 1), array()), i -> {MAIN} + i))"))
    met = met.withColumn("c", chunk).withColumn("o", F.explode(theirs))
    # a block holds the documents of chunks a <= b; where they differ, only pairs across them count
    met = met.select("p", F.least("c", "o").alias("a"), F.greatest("c", "o").alias("b"), "c", "id", "label", "n", "l", "few", "size", "last", "tokens", "at", "pivots")
    pairs = met.repartition("p", "a", "b").sortWithinPartitions("p", "a", "b").mapInArrow(lambda bs: scan_groups(bs, ["p", "a", "b"], _surviving(percent)), "p long, a int, b int, id long, label long, partners array<long>")
    pairs = cut(pairs)
    checked = texts(pairs.join(reps.select("id", "s1"), "id")).repartition("p", "a", "b").sortWithinPartitions("p", "a", "b")
    links = stars.unionByName(checked.mapInArrow(lambda bs: scan_groups(bs, ["p", "a", "b"], _verified(k, percent), 2048), "a long, b long"))
    comp = components(links).select(F.col("node").alias("rep"), "component")
    # a set that no other document has needs no look-up, and the documents of one that very many have are dealt out
    known = copies.where("copies > 1").join(comp, "rep", "left").select("n", "s1", "s2", F.coalesce("component", "rep").alias("group"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salted = profile.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"))
    alone = comp.select(F.col("rep").alias("id"), "component")
    return (
        salted.join(known, ["n", "s1", "s2", "salt"], "left")
        .join(alone, "id", "left")
        .select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("group", "component", "id").alias("component_id"))
    )
