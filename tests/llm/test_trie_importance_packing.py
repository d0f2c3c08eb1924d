"""Prefix trie, importance resampling and online packing against brute force, and on awkward rows."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from microveil.llm import importance, online_packing, prefix_trie, queries
from microveil.llm.tokens import coder

# prefix trie

NODE = "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256".split()


def in_order(rows):
    return sorted(rows, key=lambda r: tuple(-(10**12) if x is None else x for x in r))


def plain_trie(sequences):
    """Node rows of (id, turns) by a dictionary of prefixes."""
    members, ends, children = defaultdict(list), defaultdict(list), defaultdict(set)
    for i, s in sequences:
        ends[s].append(i)
        for d in range(len(s) + 1):
            members[s[:d]].append(i)
            if d:
                children[s[: d - 1]].add(s[:d])
    leaves, saved, rows = {}, {}, []
    for p in sorted(members, key=len, reverse=True):
        below = children.get(p, ())
        leaves[p] = sum(leaves[c] for c in below) or 1
        saved[p] = sum(saved[c] for c in below) + ((len(members[p]) - 1) * len(p[-1][1].encode()) if p else 0)
        sha = hashlib.sha256(",".join(map(str, sorted(ends.get(p, ())))).encode()).hexdigest()
        rows.append((min(members[p]), len(p), min(members[p[:-1]]) if p else None, len(members[p]), len(below), leaves[p], saved[p], sha))
    return in_order(rows)


def by_turn(rows):
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            turns[conv].append((turn is not None, turn or 0, role or "", text or ""))
    return {c: tuple((r, x) for _, _, r, x in sorted(t)) for c, t in turns.items()}


def shared_beginnings(rows):
    own = by_turn(rows)
    for c, s in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        yield c, own.get(c - c % 5, ())[:h] + s[h:]


def nodes_of(df):
    return in_order(tuple(r) for r in df.select(*NODE).collect())


SCHEMA = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("ranges", [1, 3, 40])
def test_trie_over_ranges_runs_and_blocks(spark, ranges):
    rng = random.Random(5)
    rows = []
    for i in range(500):  # a third are copies of one; many begin alike; prefixes of others; one is long
        n = 700 if i == 9 else rng.choice([1, 1, 2, 3, 5, 20])
        turns = [0] * 4 if rng.random() < 0.3 else [rng.choice([0, 0, 0, 1, 2]) for _ in range(n)]
        rows += [(i * 7 - 300 if i else 10**9, k, "user", f"é{x}") for k, x in enumerate(turns)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", ranges)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        turns = prefix_trie.ordered_turns(spark.createDataFrame(rows, SCHEMA))
        keys = turns.select(prefix_trie.joined_key("turns").alias("key"), "conv_id")
        assert nodes_of(prefix_trie.trie(keys, run_bytes=3000, block_rows=4)) == plain_trie(by_turn(rows).items())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_trie_many_children_and_ends_in_parts():
    """A node hands its children on early and its ids in parts, whether or not it goes on in the next range."""
    one, two = b"a" * 16 + (3).to_bytes(4, "big"), b"b" * 16 + (5).to_bytes(4, "big")
    rows = [(one, i) for i in range(7)] + [(one + bytes([99, i]) + two[2:], 100 + i) for i in range(5)] + [(two, 300)]
    got = []
    for start, stop, seam in ((0, 9, (-1, False, 1)), (9, 13, (1, False, -1))):
        t = prefix_trie.Trie(0, *seam, most_waiting=2, ends_rows=3)
        for (key, i), (last, _) in zip(rows[start:stop], [(b"", 0), *rows[start:stop]], strict=False):
            t.add(key, i, prefix_trie.common_turns(last, key))
        t.finish()
        got += t.rows
    names = [n for n, _ in prefix_trie.NODE_FIELDS]
    rows = [dict(zip(names, r, strict=True)) for r in got]
    first = [r for r in rows if r["turn"] == one]
    assert sum(r["n_convs"] for r in first) == 12 and sum(r["n_children"] for r in first) == 5 and sum(r["n_leaves"] for r in first) == 5
    assert ",".join(r["ends"] for r in first if r["ends"]) == "0,1,2,3,4,5,6"
    assert sum(r["saved_tokens"] for r in first) == 11 * 3
    last = next(r for r in rows if r["turn"] == two)
    assert last["part"] is None and last["ends_sha256"] == hashlib.sha256(b"300").hexdigest()


def test_loser_tree_merges_runs():
    rng = random.Random(1)
    unit = lambda x: bytes([x]) * prefix_trie.WIDTH
    items = [(b"".join(unit(rng.randrange(3)) for _ in range(rng.randrange(6))), i) for i in range(300)]
    blocks = []
    for run in range(7):
        for b in prefix_trie._blocks(items[run::7], run, 0, 5):
            r = b.to_pylist()[0]
            blocks.append(((r["first_key"], r["first_id"]), (r["lcps"], r["turns"], r["ids"])))
    out = list(prefix_trie.merged(iter(sorted(blocks))))
    assert [(k, i) for k, i, _ in out] == sorted(items)
    assert all(n == prefix_trie.common_turns(a, b) for (a, _, _), (b, _, n) in zip(out, out[1:], strict=False))


def test_trie_awkward_rows(spark):
    rows = [
        (None, 0, "user", "lost"), (1, None, "user", "first"), (1, 0, None, None), (1, 0, None, None), (2, 0, "", ""), (3, 0, "user", "x" * 300_000),
        (-4, 0, "a", "b"), (-4, 1, "user", "first"), (5, 0, "user", "5"), (6, 0, "user", "6"), (7, 0, "user", "7"), (9, 0, "a", "b"), (9, 1, "c", "d"),
    ]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], f"{SCHEMA}, range string, key string")
    truncated = [(c, t, r, x) for c, t, r, x in rows]
    own = by_turn(truncated)
    want = []
    for c, s in own.items():
        h, base = zlib.crc32(str(c).encode()) % 9, c - int(math.fmod(c, 5))
        want.append((c, own.get(base, ())[:h] + s[h:]))
    assert nodes_of(prefix_trie.trie(prefix_trie.shared_beginnings(df))) == plain_trie(want)
    assert any(not s for _, s in want)  # one has lost all its turns
    assert nodes_of(prefix_trie.conversation_trie(df)) == plain_trie(own.items())
    assert prefix_trie.conversation_trie(df.limit(0)).count() == 0
    texts = prefix_trie.last_turns(prefix_trie.conversation_trie(df), df)
    assert {(r["role"], r["text"]) for r in texts.where("depth = 1").collect()} == {s[0] for s in own.values()}


def test_trie_query(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert nodes_of(queries.op11_conversation_prefix_trie(spark, sf_dir)) == plain_trie(list(shared_beginnings(rows)))


# importance resampling


def features(text):
    low = "".join(c.lower() if c.isascii() else c for c in text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    return len(w), [zlib.crc32(" ".join(w[i : i + k]).encode()) % 10_000 for k in (1, 2, 3) for i in range(len(w) - k + 1)]


def plain_resample(docs, target, percent=5, least_words=20):
    found = [(i, *features(x)) for i, x in docs]
    s, t = Counter(b for _, _, f in found for b in f), Counter(b for x in target for b in features(x)[1])
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (big_s + 10_000) / ((s[b] + 1) * (big_t + 10_000)))) for b in range(10_000)]
    rows = []
    for i, n, f in found:
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        rows.append((i, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in rows if r[1] >= least_words), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    rank = {id(r): k + 1 for k, r in enumerate(able[: math.floor(percent * len(able) / 100)])}
    return in_order((r[0], *r[2:], rank.get(id(r))) for r in rows)


def sampled(df):
    return in_order(tuple(r) for r in df.select("doc_id", "n_features", "weight", "score", "rank").collect())


def test_importance_query(spark, sf_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    target = [r[0] for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("text").collect()]
    assert sampled(queries.op12_importance_resampling(spark, sf_dir)) == plain_resample(docs, target)


def test_importance_awkward_rows(spark):
    rng = random.Random(3)
    words = ["été", "A1", "b", "Zürich", "ﬀ", "日本", "x" * 400]
    long = " ".join(rng.choice(words) for _ in range(9000))
    docs = [(None, "a b c"), (1, None), (2, ""), (3, "!?-"), (4, "One"), (5, long), (5, long), (5, "a b"), (6, "y" * 700_000), (7, "- A_b.c d\x7fe")]
    docs += [(10 + i, " ".join(rng.choice(words[:5]) for _ in range(19 + i % 3))) for i in range(60)]
    frame = spark.createDataFrame([(*d, 1, 2) for d in docs], "doc_id long, text string, score int, part int")
    target = spark.createDataFrame([("A1 b été", 0), (None, 1)], "text string, weight int")
    want = plain_resample(docs, ["A1 b été", None], percent=30)
    assert sampled(importance.resample(frame, target, percent=30)) == want
    # the same where documents are over several streams
    packed = importance.streams(frame, most=500)
    gain = importance.gains(importance.counts(packed), importance.counts(importance.streams(target.selectExpr("1 AS doc_id", "text"))))
    got = in_order(tuple(r) for r in importance.weights(packed, gain).select("doc_id", "n_features", "weight", "score").collect())
    assert got == in_order(r[:4] for r in want)
    assert packed.where("exists(parts, x -> x IS NOT NULL)").count() > 1
    assert importance.resample(frame.limit(0), target).count() == 0
    assert len(sampled(importance.resample(frame, target.limit(0)))) == len(docs)


def test_words_come_whole_from_stretches(monkeypatch):
    monkeypatch.setattr(importance, "SLICE", 7)
    text = "Ab  cdefghijklmno-pé ü" * 9
    assert [w.decode() for part in importance.words_of(text) for w in part] == re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.lower())


# online packing


def packed_rows(df):
    return [r.asDict() for r in df.collect()]


def check_packing(docs, rows, size, end_id, full):
    """Every id once, gapless sequences, right checksums; with ``full`` only lengths that need no padding."""
    code = coder()
    wanted = Counter()
    for i, x in docs:
        wanted[(i, (*code.encode(x or "").tolist(), end_id))] += 1
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    for i, pieces in by_doc.items():
        ids = [k for k in wanted if k[0] == i]
        assert sum(r["length"] for r in pieces) == sum(len(k[1]) * wanted[k] for k in ids)
        if len(ids) == 1 and wanted[ids[0]] == 1:
            at, all_ids = 0, np.array(ids[0][1], "<u4")
            for r in sorted(pieces, key=lambda r: r["start"]):
                assert r["start"] == at and r["doc_tokens"] == len(all_ids)
                assert r["ids_crc32"] == zlib.crc32(all_ids[at : at + r["length"]].tobytes())
                at += r["length"]
            assert at == len(all_ids)
    lengths = []
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at and r["length"] > 0
            at += r["length"]
        assert at <= size
        lengths.append(at)
    if full:
        assert all(n == size or n & (n - 1) == 0 for n in lengths)
    return lengths


def test_packing_query(spark, sf_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    rows = packed_rows(queries.op13_online_packing(spark, sf_dir))
    lengths = check_packing(docs, rows, 2048, 1, True)
    assert sum(n < 2048 for n in lengths) <= 11  # one group of leftovers


def plain_online(lengths, size, most):
    """The rule without cutting, with a list of windows: [free, [pieces]]; closed ones, open ones."""
    windows, done = [], []
    for i, n in enumerate(lengths):
        fits = [w for w in windows if w[0] >= n]
        if fits:
            w = min(fits, key=lambda w: (w[0], w[2]))
        else:
            if len(windows) == most:
                fullest = min(windows, key=lambda w: (w[0], w[2]))
                windows.remove(fullest)
                done.append(fullest[1])
            w = [size, [], len(done) + len(windows)]
            windows.append(w)
        w[0] -= n
        w[1].append(i)
        if not w[0]:
            windows.remove(w)
            done.append(w[1])
    return done, [w[1] for w in windows]


def test_online_rule_against_plain_version():
    rng = random.Random(2)
    lengths = [rng.randrange(1, 40) for _ in range(2000)]
    done = []
    windows = online_packing.Windows(40, 6, False, lambda pieces: done.append([p[0] for p in pieces]))
    for i, n in enumerate(lengths):
        windows.place(i, 0, np.zeros(n, "<u4"), n)
        assert len(windows.gaps) == len(windows.held) <= 6
    want, still = plain_online(lengths, 40, 6)
    assert done == want
    assert sorted([p[0] for p in w] for w in windows.rest()) == sorted(still)


@pytest.mark.parametrize("may_cut", [True, False])
def test_packing_awkward_rows(spark, may_cut):
    rng = random.Random(4)
    text = lambda n: " ".join(rng.choice(["one", "two", "été", "日本"]) for _ in range(n))
    docs = [(None, "a"), (None, None), (1, ""), (2, None), (3, text(90 if may_cut else 20)), (3, "b"), (3, "b")] + [(10 + i, text(i % 17)) for i in range(150)]
    if may_cut:
        docs.append((4, text(30_000)))
    df = spark.createDataFrame([(*d, 5, "x") for d in docs], "doc_id long, text string, length int, sequence_id string").repartition(5)
    got = online_packing.pack_online(df, size=96, end_id=1, open_windows=3, may_cut=may_cut, group_tokens=400)
    rows = packed_rows(got)
    lengths = check_packing(docs, rows, 96, 1, may_cut)
    if not may_cut:
        assert all(r["start"] == 0 and r["length"] == r["doc_tokens"] for r in rows)
        assert sum(lengths) > 0.7 * 96 * len(lengths)
        with pytest.raises(Exception, match="over a window"):
            online_packing.pack_online(df, size=8, may_cut=False).count()
    assert online_packing.pack_online(df.limit(0)).count() == 0
