"""Prefix trie of conversations by an external mergesort that knows common prefixes.

A turn is 20 bytes: the md5 of its role and text, and the length of its text. A
conversation is the string of its turns, so byte order puts every prefix before what it
begins, and all conversations below a node of the trie lie together. Conversations are
dealt to ranges of (turns, id). In a range, each batch is sorted into a run; a run
carries for every conversation how many turns it shares with the one before it (LCP) and only
the turns after those, and leaves as blocks of bounded size. Spark sorts, and spills, the blocks by
their first conversation. A loser tree merges the runs: heads with different LCPs to the
last output are ordered by those alone, so shared turns are not compared again; a block is
loaded when the output reaches its first conversation, so a run has one block in memory.

The merged stream keeps a stack of the nodes on the path of the current conversation. A node
that the next conversation leaves is finished and emitted. A node that goes on in the next
range is emitted in parts that add up: how many turns the first conversation of a range shares
with the last of the range before is found beforehand, so each range knows which nodes it is the
first to open. Parts are folded by node in the order of ranges. Children of such nodes get their
parent's name by a join on range and parent, so those of a hot parent stay dealt out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from microveil.llm.shared import cut, small_batches

WIDTH = 20  # bytes a turn
BLOCKS = "range int, run int, first_key binary, first_id long, last_key binary, lcps array<int>, turns array<binary>, ids array<long>"
BLOCK_KINDS = [pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.binary()), pa.list_(pa.int64())]
NODES = (
    "range int, part int, path binary, parent binary, depth long, turn binary, conv_id long, parent_conv_id long, n_convs long, "
    "n_children long, n_leaves long, saved_tokens long, ends_sha256 string, ends string, asked boolean"
)
KINDS = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string(), "boolean": pa.bool_()}
NODE_FIELDS = [tuple(f.split()) for f in NODES.split(", ")]
NONE = hashlib.sha256(b"").hexdigest()


def turn_key(role: str, text: str) -> Column:
    """20 bytes that stand for a turn; null role or text counts as empty."""
    r, t = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role, text))
    size = F.octet_length(t)
    return F.unhex(F.concat(F.md5(F.concat(F.octet_length(r).cast("string"), F.lit(":"), r, t)), F.lpad(F.hex(size.cast("long")), 8, "0")))


def ordered_turns(conversations: DataFrame, near: Column | None = None, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(near, conv_id, turns): the turn keys of each conversation in the order of ``turn``, null first.

    Equal turn numbers go by role, then by key. Rows of a null id take no part. ``near`` is an
    expression of the id; conversations where it agrees end up in one task.
    """
    c = conversations.select(F.col(id_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("t"), F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("r"), turn_key(role_col, text_col).alias("k")).where("conv_id IS NOT NULL")
    c = c.withColumn("near", near if near is not None else F.col("conv_id"))
    turns = F.transform(F.sort_array(F.collect_list(F.struct("t", "r", "k"))), lambda x: x["k"])
    return c.repartition("near").groupBy("near", "conv_id").agg(turns.alias("turns"))


def joined_key(turns: Column | str) -> Column:
    """An array of turn keys as one string of bytes."""
    return F.unhex(F.array_join(F.transform(turns, F.hex), ""))


def common_turns(a: bytes, b: bytes, start: int = 0) -> int:
    """How many turns two conversations share from the first on, ``start`` of which are known."""
    n = min(len(a), len(b)) // WIDTH
    i = start
    if a[i * WIDTH : n * WIDTH] == b[i * WIDTH : n * WIDTH]:
        return n
    while a[i * WIDTH : (i + 1) * WIDTH] == b[i * WIDTH : (i + 1) * WIDTH]:
        i += 1
    return i


# runs


def _blocks(run: list[tuple[bytes, int]], number: int, here: int, rows: int, most_bytes: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The run in order, as blocks of up to ``rows`` conversations or about ``most_bytes``; each starts with a whole one."""
    run.sort()
    lcps, turns, ids, size, before = [], [], [], 0, b""
    names = [f.split()[0] for f in BLOCKS.split(", ")]
    for at, (key, conv_id) in enumerate(run):
        n = common_turns(before, key) if lcps else 0
        lcps.append(n)
        turns.append(key[n * WIDTH :])
        ids.append(conv_id)
        size += len(turns[-1])
        before = key
        if len(ids) == rows or size >= most_bytes or at + 1 == len(run):
            block = [here, number, turns[0], ids[0], key, lcps, turns, ids]
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(block, BLOCK_KINDS, strict=True)], names=names)
            lcps, turns, ids, size = [], [], [], 0


def _runs(batches, run_bytes: int, block_rows: int) -> Iterator[pa.RecordBatch]:
    """Sorted runs of about ``run_bytes``, as blocks."""
    here = TaskContext.get().partitionId()
    run, size, number = [], 0, 0
    for b in batches:
        for key, conv_id in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            run.append((key, conv_id))
            size += len(key) + 100
            if size >= run_bytes:
                yield from _blocks(run, number, here, block_rows)
                run, size, number = [], 0, number + 1
    yield from _blocks(run, number, here, block_rows)


# merging


class Head:
    """The current conversation of a run; ``lcp`` is what it shares with the last output."""

    __slots__ = ("block", "at", "key", "conv_id", "lcp")

    def __init__(self, block: tuple, last: bytes):
        self.block, self.at = block, 0
        self.key, self.conv_id = block[1][0], block[2][0]
        self.lcp = common_turns(last, self.key)

    def step(self) -> bool:
        """The next one of the block, right after this one was put out; False at its end."""
        self.at += 1
        lcps, turns, ids = self.block
        if self.at == len(ids):
            return False
        self.lcp = lcps[self.at]
        self.key = self.key[: self.lcp * WIDTH] + turns[self.at]
        self.conv_id = ids[self.at]
        return True


class LoserTree:
    """Tournament of the heads of runs; every inner node keeps the loser of its match."""

    def __init__(self, heads: list[Head]):
        size = 1
        while size < len(heads):
            size *= 2
        self.size, self.losers = size, [None] * size
        self.leaf = {id(h): size + i for i, h in enumerate(heads)}
        up = [None] * size + heads + [None] * (size - len(heads))
        for i in range(size - 1, 0, -1):
            up[i], self.losers[i] = self.match(up[2 * i], up[2 * i + 1])
        self.winner = up[1]

    @staticmethod
    def match(a: Head | None, b: Head | None) -> tuple:
        """(smaller, larger); the loser's LCP becomes that with the winner."""
        if a is None or b is None:
            return (b, a) if a is None else (a, b)
        if a.lcp != b.lcp:  # the one that shares more with the last output comes first
            return (a, b) if a.lcp > b.lcp else (b, a)
        n = common_turns(a.key, b.key, a.lcp)
        first, second = (a, b) if (a.key[n * WIDTH :], a.conv_id) < (b.key[n * WIDTH :], b.conv_id) else (b, a)
        second.lcp = n
        return first, second

    def advance(self) -> None:
        """Plays the winner's path again after its run moved on, or left if the run's block is at its end."""
        w = self.winner
        i = self.leaf[id(w)] // 2
        w = w if w.step() else None
        while i:
            w, self.losers[i] = self.match(w, self.losers[i])
            i //= 2
        self.winner = w

    def left(self) -> list[Head]:
        return [h for h in [self.winner, *self.losers] if h is not None]


def merged(blocks: Iterator[tuple]) -> Iterator[tuple[bytes, int, int]]:
    """(key, conv_id, LCP with the one before) of all runs in order, from (first, block) sorted by ``first``.

    At the start nothing has been put out, so LCPs count from nothing.
    """
    tree, last = LoserTree([]), b""
    upcoming = next(blocks, None)
    while True:
        w = tree.winner
        if upcoming is not None and (w is None or (w.key, w.conv_id) >= upcoming[0]):
            heads = tree.left()
            for h in heads:  # LCPs of losers are those with the winners that beat them
                h.lcp = common_turns(last, h.key)
            tree = LoserTree([*heads, Head(upcoming[1], last)])
            upcoming = next(blocks, None)
            continue
        if w is None:
            return
        yield w.key, w.conv_id, w.lcp
        last = w.key
        tree.advance()


# nodes


class Node:
    """A node on the open path. Sums are those of its subtree in this range."""

    __slots__ = ("path", "turn", "new", "n", "least", "children", "leaves", "saved", "childless", "ends", "sha", "waiting", "asked", "parted")

    def __init__(self, path: bytes, turn: bytes | None, new: bool, childless: bool):
        self.path, self.turn, self.new = path, turn, new
        self.n = self.children = self.saved = 0
        self.leaves = int(new)  # whoever opens a node counts it as a leaf until it has a child
        self.childless = childless
        self.least, self.ends, self.sha, self.waiting, self.asked, self.parted = None, [], None, [], False, False


class Trie:
    """Turns a merged stream into node rows.

    ``begun``: turns that the first conversation shares with the last one of the range before, -1 if there is none;
    ``ended``: whether that one has no turn more; ``goes_on``: turns that the last one shares with the next range, -1 if none.
    """

    def __init__(self, here: int, begun: int, ended: bool, goes_on: int, most_waiting: int = 10_000, ends_rows: int = 50_000):
        self.here, self.begun, self.ended, self.goes_on = here, begun, ended, goes_on
        self.most_waiting, self.ends_rows = most_waiting, ends_rows
        self.open: list[Node] = []
        self.rows: list[tuple] = []
        self.parts = 0
        self.some = False  # whether a conversation has been added

    def _open(self, key: bytes, depth: int) -> None:
        turn = key[(depth - 1) * WIDTH : depth * WIDTH] if depth else None
        path = hashlib.md5((self.open[-1].path if depth else b"") + (turn or b"")).digest()
        new = self.some or depth > self.begun
        if new and depth:
            above = self.open[-1]
            above.children += 1
            if above.childless:
                above.leaves -= 1
                above.childless = False
        # childless so far are new nodes and the one where the range before ended
        self.open.append(Node(path, turn, new, new or (self.ended and depth == self.begun)))

    def add(self, key: bytes, conv_id: int, lcp: int) -> None:
        if self.open:
            while len(self.open) - 1 > lcp:
                self._close(False)
        for depth in range(len(self.open), len(key) // WIDTH + 1):
            self._open(key, depth)
        self.some = True
        top = self.open[-1]
        top.n += 1
        top.least = conv_id if top.least is None else min(top.least, conv_id)
        top.ends.append(conv_id)
        if len(top.ends) >= self.ends_rows:
            self._flush_ends(top)

    def _flush_ends(self, v: Node) -> None:
        depth = len(self.open) - 1
        text = ",".join(map(str, v.ends))
        v.ends = []
        if not v.new or depth <= self.goes_on:  # the node is, or may be, one in parts, each of which carries its ids
            v.parted = True
            self._part(v, depth, n=0, least=None, children=0, leaves=0, saved=0, ends=text)
        else:
            if v.sha is None:
                v.sha = hashlib.sha256(text.encode())
            else:
                v.sha.update(b"," + text.encode())

    def _part(self, v: Node, depth: int, n, least, children, leaves, saved, ends) -> None:
        parent = self.open[depth - 1].path if depth else None
        self.rows.append((self.here, self.parts, v.path, parent, depth, v.turn, least, None, n, children, leaves, saved, None, ends, True))
        self.parts += 1

    def _close(self, last: bool) -> None:
        """Takes the deepest open node off the stack; ``last``: at the end of the range."""
        v, depth = self.open[-1], len(self.open) - 1
        size = int.from_bytes(v.turn[16:], "big") if v.turn else 0
        v.saved += (v.n - int(v.new)) * size
        if depth:
            above = self.open[-2]
            above.n, above.leaves, above.saved = above.n + v.n, above.leaves + v.leaves, above.saved + v.saved
            above.least = v.least if above.least is None else min(above.least, v.least)
        if not v.new or v.parted or (last and depth <= self.goes_on):
            if depth:
                self.open[-2].asked = True
            self._give(v, None)
            self._part(v, depth, v.n, v.least, v.children, v.leaves, v.saved, ",".join(map(str, v.ends)) if v.ends else None)
            self.open.pop()
            return
        if v.sha is None:
            sha = hashlib.sha256(",".join(map(str, v.ends)).encode()).hexdigest() if v.ends else NONE
        else:
            if v.ends:
                v.sha.update(b"," + ",".join(map(str, v.ends)).encode())
            sha = v.sha.hexdigest()
        self._give(v, v.least)
        self.open.pop()
        parent = self.open[-1] if depth else None
        row = (self.here, None, v.path, parent and parent.path, depth, v.turn, v.least, None, v.n, v.children, v.leaves, v.saved, sha, None, v.asked)
        if parent is None:
            self.rows.append(row)
        else:
            parent.waiting.append(row)
            if len(parent.waiting) >= self.most_waiting:  # their parent's name comes by a join
                parent.asked = True
                self._give(parent, None)

    def _give(self, v: Node, name: int | None) -> None:
        self.rows.extend((*r[:7], name, *r[8:]) for r in v.waiting)
        v.waiting = []

    def finish(self) -> None:
        while self.open:
            self._close(True)

    def taken(self, least: int = 0) -> Iterator[pa.RecordBatch]:
        if len(self.rows) > least:
            columns = zip(zip(*self.rows, strict=True), NODE_FIELDS, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, KINDS[t]) for c, (_, t) in columns], names=[n for n, _ in NODE_FIELDS])
            self.rows = []


def _nodes(batches, seams: dict[int, tuple[int, bool, int]]) -> Iterator[pa.RecordBatch]:
    """Node rows of the ranges of a partition, whose blocks come sorted by range and first conversation."""
    held: list[tuple] = []

    def rows():
        for b in batches:
            yield from zip(*[c.to_pylist() for c in b.columns], strict=True)

    source = rows()
    held.append(next(source, None))
    while held[0] is not None:
        here = held[0][0]

        def blocks(here=here):
            while held[0] is not None and held[0][0] == here:
                r, held[0] = held[0], next(source, None)
                yield (r[1], r[2]), (r[3], r[4], r[5])

        trie = Trie(here, *seams[here])
        for key, conv_id, lcp in merged(blocks()):
            trie.add(key, conv_id, lcp)
            yield from trie.taken(5_000)
        trie.finish()
        yield from trie.taken()


def _seam(batches) -> Iterator[pa.RecordBatch]:
    for b in batches:
        last, first = b.column("last").to_pylist(), b.column("first").to_pylist()
        n = [common_turns(x, y) for x, y in zip(last, first, strict=True)]
        ended = [len(x) == k * WIDTH for x, k in zip(last, n, strict=True)]
        yield pa.RecordBatch.from_arrays([b.column("range"), pa.array(n, pa.int32()), pa.array(ended)], names=["range", "n", "ended"])


def _seams(blocks: DataFrame) -> dict[int, tuple[int, bool, int]]:
    """Per range what its ends share with the ranges beside it; two numbers a range come to the driver."""
    ends = blocks.groupBy("range").agg(F.min("first_key").alias("first"), F.max("last_key").alias("last"))
    found = sorted(r[0] for r in ends.select("range").collect())
    out = {i: [-1, False, -1] for i in found}
    if len(found) > 1:
        beside = blocks.sparkSession.createDataFrame(list(zip(found, found[1:], strict=False)), "before int, range int")
        both = beside.join(ends.select(F.col("range").alias("before"), "last"), "before").join(ends.select("range", "first"), "range").select("range", "last", "first")
        before = dict(zip(found[1:], found, strict=False))
        for r in both.mapInArrow(_seam, "range int, n int, ended boolean").collect():
            out[r["range"]][:2] = r["n"], r["ended"]
            out[before[r["range"]]][2] = r["n"]
    return {i: tuple(v) for i, v in out.items()}


def _folded(batches) -> Iterator[pa.RecordBatch]:
    """Adds up the parts of each node, sorted by (path, range, part)."""
    names = ["path", "parent", "depth", "turn", "conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    kinds = ["binary", "binary", "long", "binary", "long", "long", "long", "long", "long", "string"]
    now, sha, rows = None, None, []

    def end():
        if now is not None:
            rows.append((*now, sha.hexdigest()))

    def batch():
        columns = zip(zip(*rows, strict=True), kinds, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(c, KINDS[t]) for c, t in columns], names=names)

    some = False
    for b in batches:
        for path, parent, depth, turn, conv_id, n, children, leaves, saved, ends in zip(*[c.to_pylist() for c in b.columns], strict=True):
            if now is None or now[0] != path:
                end()
                now, sha, some = [path, parent, depth, turn, None, 0, 0, 0, 0], hashlib.sha256(), False
            if conv_id is not None:
                now[4] = conv_id if now[4] is None else min(now[4], conv_id)
            for k, x in zip((5, 6, 7, 8), (n, children, leaves, saved), strict=True):
                now[k] += x
            if ends is not None:
                sha.update((("," if some else "") + ends).encode())
                some = True
        if len(rows) > 5_000:
            yield batch()
            rows = []
    end()
    if rows:
        yield batch()


def trie(keys: DataFrame, run_bytes: int = 32 << 20, block_rows: int = 512) -> DataFrame:
    """The trie of (key, conv_id): one row a node.

    conv_id (smallest member), depth, parent_conv_id (null for the root), n_convs (members), n_children, n_leaves
    (childless nodes of the subtree, itself included), saved_tokens (over the subtree, members less one times the bytes of the
    last text), ends_sha256 (hex digest of the ids of members that end here, ascending, comma-joined), and of use in joins: path,
    parent (16 bytes that stand for the sequence of turns) and turn (20 bytes, null for the root). A key without turns ends at the
    root. An empty input has no root. An id that occurs more than once is a member as often. ``run_bytes`` and ``block_rows`` bound
    a task's memory: a run while it is made, a block of every run of its range while they are merged, and
    10,000 finished children a node.
    """
    small_batches(keys.sparkSession)
    ranged = keys.select("key", "conv_id").repartitionByRange("key", "conv_id")
    blocks = cut(ranged.mapInArrow(partial(_runs, run_bytes=run_bytes, block_rows=block_rows), BLOCKS))
    seams = _seams(blocks)
    # a partition is a range: no shuffle, and Spark's sort of blocks spills where it must
    ordered = blocks.sortWithinPartitions("range", "first_key", "first_id").select("range", "first_key", "first_id", "lcps", "turns", "ids")
    nodes = cut(ordered.mapInArrow(partial(_nodes, seams=seams), NODES))
    given = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256", "path", "parent", "turn"]
    whole, parts = nodes.where("part IS NULL"), nodes.where("part IS NOT NULL")
    fold = ["path", "parent", "depth", "turn", "conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    folded = cut(parts.repartition("path").sortWithinPartitions("path", "range", "part").select(*fold, "ends").mapInArrow(_folded, ", ".join(
        f"{n} {t}" for n, t in [("path", "binary"), ("parent", "binary"), ("depth", "long"), ("turn", "binary"), ("conv_id", "long"), ("n_convs", "long"), ("n_children", "long"), ("n_leaves", "long"), ("saved_tokens", "long"), ("ends_sha256", "string")]
    )))
    # names of parents that were not known in the range: parts of nodes, and nodes with many children
    named = folded.select(F.col("path").alias("parent"), F.col("conv_id").alias("_name"))
    of_range = parts.select("range", F.col("path").alias("parent")).distinct().join(named, "parent")
    asked = whole.where("asked").select("range", F.col("path").alias("parent"), F.col("conv_id").alias("_name"))
    open_ended = whole.where("parent_conv_id IS NULL AND depth > 0").drop("parent_conv_id").join(of_range.unionByName(asked), ["range", "parent"]).withColumnRenamed("_name", "parent_conv_id")
    names = named.unionByName(asked.drop("range"))
    seamed = folded.join(names, "parent", "left").withColumnRenamed("_name", "parent_conv_id")
    closed = whole.where("parent_conv_id IS NOT NULL OR depth = 0")
    return closed.select(*given).unionByName(open_ended.select(*given)).unionByName(seamed.select(*given))


def conversation_trie(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``trie`` of whole conversations: rows of one id by turn, null first; null role or text counts as empty.

    Rows of a null id take no part; equal turn numbers go by role, then by a digest of the text. One conversation's
    turns, 20 bytes each, are collected in a row.
    """
    turns = ordered_turns(conversations, None, id_col, turn_col, role_col, text_col)
    return trie(turns.select(joined_key("turns").alias("key"), "conv_id"))


def last_turns(nodes: DataFrame, conversations: DataFrame, role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``nodes`` with ``role`` and ``text`` of their last turn, null for the root."""
    texts = conversations.select(turn_key(role_col, text_col).alias("turn"), F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return nodes.join(texts.groupBy("turn").agg(F.first("role").alias("role"), F.first("text").alias("text")), "turn", "left")


def shared_beginnings(conversations: DataFrame, most: int = 5, turns: int = 9) -> DataFrame:
    """(key, conv_id) of conversations whose beginnings are those of a neighbour.

    Conversation c begins with the first h turns of conversation c - c % ``most`` (all if it has fewer, none if it is not there), h being
    the crc32 of c in decimals modulo ``turns``, and goes on with its own turns after its first h.
    """
    own = ordered_turns(conversations, F.col("conv_id") - F.col("conv_id") % most)
    family = Window.partitionBy("near")
    base = F.first(F.when(F.col("conv_id") == F.col("near"), F.slice("turns", 1, turns - 1)), ignorenulls=True).over(family)
    h = (F.crc32(F.col("conv_id").cast("string")) % turns).cast("int")
    x = own.withColumns({"base": base, "h": h})
    begin = F.when(F.col("base").isNotNull(), F.slice("base", 1, F.col("h"))).otherwise(F.array().cast("array<binary>"))
    rest = F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns"), F.lit(1)))
    return x.select(joined_key(F.concat(begin, rest)).alias("key"), "conv_id")
