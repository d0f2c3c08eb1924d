"""Line deduplication, n-gram Jaccard join, decontamination and neighbours against brute force."""

from __future__ import annotations

import itertools
import random
import re

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from microveil.llm import decontaminate, jaccard_join, line_dedup, permutation_index, textscan
from microveil.llm.shared import components, scan_groups

DOCS = "doc_id long, text string, n_shingles string"


def words(rng, n, vocabulary=400):
    return [f"w{rng.randint(0, vocabulary)}" for _ in range(n)]


def edited(rng, text, n):
    chars = list(text)
    for _ in range(n):
        at = rng.randrange(len(chars))
        kind = rng.randrange(3)
        if kind == 0:
            chars[at] = rng.choice("xyz")
        elif kind == 1:
            chars.insert(at, rng.choice("xyz"))
        else:
            del chars[at]
    return "".join(chars)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


# textscan


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="aB é\t\n\x0b z", max_size=20), max_size=6))
def test_words_as_by_pattern(texts):
    import pyarrow as pa

    got = []
    for first, last, data, off in textscan.chunks(pa.array(texts, pa.string())):
        start, end, at = textscan.words(data, off)
        for i in range(last - first):
            got.append([bytes(data[a:b]).decode() for a, b in zip(start[at[i] : at[i + 1]], end[at[i] : at[i + 1]], strict=True)])
    assert got == [re.findall(r"[^\x20\x09-\x0D]+", t) for t in texts]


def test_equal_spans_hash_alike():
    data = np.frombuffer(b"xx Ab yy aB", np.uint8)
    start, end, _ = textscan.words(data, np.array([0, 11]))
    h = textscan.span_hashes(data, start, end)
    assert h[1] == h[3] and len(set(h.tolist())) == 3


# line deduplication


@settings(max_examples=200, deadline=None)
@given(st.text("abé", min_size=1, max_size=30), st.text("abé", min_size=1, max_size=30), st.integers(0, 3))
def test_banded_distance(a, b, tau):
    flat = np.frombuffer((a + b).encode("utf-32-le"), np.uint32)
    got = line_dedup.within(flat, np.array([0]), np.array([len(a)]), np.array([len(a)]), np.array([len(b)]), tau)
    assert bool(got[0]) == (distance(a, b) <= tau)


def brute_lines(rows, tau=2, share=8, least=1):
    seen, out = [], {}
    for i, text in sorted(rows):
        kept = []
        for line in (text or "").split("\n"):
            if len(line) < least or not line.strip():
                kept.append(line)
                continue
            if line in seen:
                continue
            bound = lambda y: min(tau, min(len(y), len(line)) // share)
            near = any(abs(len(y) - len(line)) <= bound(y) and distance(line, y) <= bound(y) for y in seen)
            seen.append(line)
            if not near:
                kept.append(line)
        out[i] = "\n".join(kept) if text is not None else None
    return out


@pytest.mark.parametrize(("block", "most"), [(4096, 1 << 20), (4, 1 << 20), (3, 8)])
def test_lines_against_brute_force(spark, monkeypatch, block, most):
    monkeypatch.setattr(line_dedup, "BLOCK_LINES", block)
    monkeypatch.setattr(line_dedup, "MOST", most)
    rng = random.Random(5)
    base = [" ".join(words(rng, rng.randint(1, 9), 30)) for _ in range(25)]
    # a family whose lines share long segments, some of them near one another
    base += [f"Copyright (c) {rng.randint(1980, 2020)} {rng.choice(['Ann', 'Bob', 'Cleo'])} {rng.choice(['Smith', 'Jones'])}, all rights reserved" for _ in range(40)]
    rows = []
    for i in range(60):
        lines = [rng.choice(["", "short", "}", "}}", edited(rng, rng.choice(base), rng.randint(0, 4)), rng.choice(base), " ".join(words(rng, 6))]) for _ in range(rng.randint(0, 6))]
        rows.append((i, "\n".join(lines)))
    rows += [(100, None), (101, ""), (102, "é" * 40), (103, "é" * 39 + "e")]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, n_lines string")
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup(docs).collect()}
    assert got == brute_lines(rows)


def test_lines_edges(spark):
    assert line_dedup.dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    same = spark.createDataFrame([(1, "a line that is repeated here"), (1, "a line that is repeated here"), (None, "a line that is repeated here"), (None, None)], "doc_id long, text string")
    got = sorted(((r["doc_id"] is None, r["text"] or "", r["n_dropped"]) for r in line_dedup.dedup(same).collect()))
    assert got == [(False, "", 1), (False, "", 1), (True, "", 0), (True, "a line that is repeated here", 0)]


def test_groups_in_parts():
    """Groups come whole up to ``most`` rows, larger ones in parts that are told apart."""
    import pyarrow as pa

    rng = random.Random(2)
    keys = sorted(rng.choice([1, 2, 2, 2, 2, 2, 2, 3, 4, 5]) for _ in range(300))
    batches = [pa.RecordBatch.from_pydict({"k": keys[i : i + 7]}) for i in range(0, 300, 7)]
    seen = []

    def work(t, part):
        seen.append((t["k"].to_pylist(), part))
        return []

    list(scan_groups(iter(batches), ["k"], work, least=10, most=40))
    assert [k for x, _ in seen for k in x] == keys
    whole = [k for x, part in seen if not part for k in set(x)]
    assert len(whole) == len(set(whole)) and all(len(set(x)) == 1 for x, part in seen if part) and any(part for _, part in seen)
    assert not set(whole) & {x[0] for x, part in seen if part}


def test_long_line(spark):
    text = "é long word " * 40_000
    docs = spark.createDataFrame([(1, text), (2, text[:-1] + "!"), (3, "é\n" + text)], "doc_id long, text string")
    assert {r["doc_id"]: (r["n_lines"], r["n_dropped"]) for r in line_dedup.dedup(docs).collect()} == {1: (1, 0), 2: (1, 1), 3: (2, 1)}


def test_probes_find_all_alignments():
    rng = random.Random(1)
    for tau in (1, 2, 3):
        for _ in range(300):
            a = "".join(rng.choice("abcd") for _ in range(rng.randint(12, 30)))
            b = edited(rng, a, rng.randint(0, tau))
            short, long_ = sorted((a, b), key=len)
            if distance(a, b) > tau:
                continue
            n, delta = len(short), len(long_) - len(short)
            hit = False
            for d, i, lo, hi in line_dedup.probes(tau):
                if d == delta:
                    (p,), (size,) = line_dedup.segments(np.array([n]), tau, i)
                    hit |= any(0 <= p + s and long_[p + s : p + s + size] == short[p : p + size] for s in range(lo, hi + 1))
            assert hit


# n-gram Jaccard join


def brute_links(rows, k, percent):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()
    root = {i: i for i in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for x in ids:
        for y in ids:
            if x < y and sets[x] and sets[y] and 100 * len(sets[x] & sets[y]) >= percent * len(sets[x] | sets[y]):
                a, b = sorted((top(x), top(y)))
                root[b] = a
    return {i: (len(sets[i]), top(i)) for i in ids}


@pytest.mark.parametrize(("k", "percent"), [(3, 90), (5, 80), (1, 50)])
@pytest.mark.parametrize("block", [500_000, 300])
def test_links_against_brute_force(spark, monkeypatch, k, percent, block):
    monkeypatch.setattr(jaccard_join, "BLOCK_SHINGLES", block)
    rng = random.Random(k)
    base = [words(rng, rng.randint(3, 60)) for _ in range(12)]
    rows = []
    for i in range(120):
        w = list(rng.choice(base))
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = f"e{rng.randint(0, 500)}"
        rows.append((i, " ".join(w)))
    rows += [(200, None), (201, ""), (202, " \n"), (203, "one"), (204, "ONE"), (205, "one two"), (206, "one two")]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], DOCS)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.link(docs, k=k, percent=percent).collect()}
    assert got == brute_links(rows, k, percent)


@pytest.mark.parametrize("star", [256, 5])
def test_families_of_near_copies(spark, monkeypatch, star):
    """Groups whose documents all link, groups with strangers amid them, and chains; in blocks and whole."""
    monkeypatch.setattr(jaccard_join, "STAR", star)
    monkeypatch.setattr(jaccard_join, "FAMILY", 32 if star == 256 else 1)
    monkeypatch.setattr(jaccard_join, "BLOCK_SHINGLES", 600)
    rng = random.Random(star)
    rows = []
    for family in range(4):
        base = [f"f{family}w{j}" for j in range(24)]
        rows += [(len(rows) + i, " ".join([*base, f"user{i}"])) for i in range(60)]
        rows += [(len(rows) + i, " ".join([*base[: 24 - i], *words(rng, i)])) for i in range(1, 9)]
        chain = [f"c{family}w{j}" for j in range(60)]
        for _ in range(12):
            chain[rng.randrange(60)] = f"n{rng.randint(0, 9999)}"
            rows.append((len(rows), " ".join(chain)))
    ids = rng.sample(range(10_000), len(rows))
    rows = [(i, t) for i, (_, t) in zip(ids, rows, strict=True)]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], DOCS)
    for k, percent in ((3, 80), (3, 90)):
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.link(docs, k=k, percent=percent).collect()}
        assert got == brute_links(rows, k, percent)


def test_links_edges(spark):
    assert jaccard_join.link(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    docs = spark.createDataFrame([(None, "a b c"), (1, "a b c d e f"), (1, "a b c d e f"), (2, "A B c d e f")], "doc_id long, text string")
    assert sorted(tuple(r) for r in jaccard_join.link(docs, k=3).collect()) == [(1, 4, 1), (2, 4, 1)]


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 160)] + [(7, 7)]
    root = {x: x for e in edges for x in e}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in edges:
        a, b = sorted((top(a), top(b)))
        root[b] = a
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: top(x) for e in edges if e[0] != e[1] for x in e}


# decontamination


def test_decontamination_against_brute_force(spark):
    rng = random.Random(9)
    items = [(i, " ".join(words(rng, rng.choice([5, 9, 14, 30])))) for i in range(12)]
    rows = []
    for i in range(80):
        w = words(rng, rng.randint(0, 60))
        if i % 2:
            part = rng.choice(items)[1].split()
            lo = rng.randint(0, max(0, len(part) - 16))
            part = part[lo : lo + rng.randint(8, 30)]
            for _ in range(rng.randint(0, 3)):
                part[rng.randrange(len(part))] = "changed"
            at = rng.randint(0, len(w))
            w[at:at] = part
        rows.append((i, " ".join(w).upper() if i % 3 else ", ".join(w)))
    rows += [(100, None), (101, "")]

    def found(text):
        w = re.findall(r"[^\W_]+", (text or "").lower())
        out = set()
        for name, t in items:
            b = re.findall(r"[^\W_]+", t.lower())
            if len(b) < decontaminate.SPAN:
                continue
            need, size = -(-min(len(b), 16) * 13 // 16), min(16, len(b))
            for shift in range(-len(b), len(w)):
                same = [int(0 <= j + shift < len(w) and w[j + shift] == x) for j, x in enumerate(b)]
                seeded = any(all(same[p + o] and same[p + o + 1] for o in m) for m in decontaminate.MASKS for p in range(len(b) - decontaminate.SPAN + 1) if all(p + o + 1 < len(b) for o in m) and 0 <= p + shift and p + shift + decontaminate.SPAN <= len(w))
                if seeded and any(sum(same[s : s + size]) >= need for s in range(len(b) - size + 1)):
                    out.add(name)
        return sorted(out)

    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, items string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r["doc_id"]: (r["contaminated"], r["items"]) for r in decontaminate.contaminated(docs, bench).collect()}
    assert got == {i: (bool(found(t)), found(t)) for i, t in rows}
    assert sum(x for x, _ in got.values()) > 8
    nothing = decontaminate.contaminated(docs, spark.createDataFrame([], "item_id long, text string"))
    assert nothing.where("contaminated").count() == 0 and nothing.count() == len(rows)
    assert decontaminate.contaminated(docs.limit(0), bench).count() == 0


def test_every_allowed_replacement_is_found(spark):
    items, rows, want = [], [], {}
    for n in (*range(4, 17), 20):
        w = [f"i{n}x{j}" for j in range(n)]
        items.append((n, " ".join(w)))
        size = min(n, 16)
        free = size - -(-size * 13 // 16)
        # every choice of replaced words in one window, then one too many, amid other words and alone
        for k in (free, free + 1):
            for places in itertools.combinations(range(size), k):
                if k > free and sum(places) % 5 and n > 8:
                    continue
                text = [f"r{j}" if j in places or j >= size else x for j, x in enumerate(w)]
                for around in ("some {} other", "{}"):
                    want[len(rows)] = [n] if k == free else []
                    rows.append((len(rows), around.format(" ".join(text))))
        # the document ends inside the item
        for cut in range(free + 1):
            want[len(rows)] = [n]
            rows.append((len(rows), " ".join(w[cut : size - free + cut])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["items"] for r in decontaminate.contaminated(docs, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == want
    with pytest.raises(ValueError, match="too few"):
        decontaminate.contaminated(docs, docs, item_col="doc_id", least=9)


def test_short_items_are_found_whole(spark):
    items = [(1, "Yes!"), (2, "42 km"), (3, "in the end"), (4, "What is it called?"), (5, "?"), (6, None), (7, "a long item whose first words are yes and 42")]
    texts = ["yes", "no", "oh yes, yes, yes", "it is 42 km away", "42 miles, 5 km", "In the end: 42 KM", "what is it called", "what was it called", "in the", "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["items"] for r in decontaminate.contaminated(docs, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == dict(enumerate([[1], [], [1], [2], [], [2, 3], [4], [], [], [], []]))


def test_shuffled_seeds(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "SMALL", 0)
    text = "the quick brown fox jumps over the lazy dog again and again until dawn breaks"
    docs = spark.createDataFrame([(1, "so " + text), (2, "clean")], "doc_id long, text string")
    got = decontaminate.contaminated(docs, spark.createDataFrame([(5, text)], "item_id long, text string"))
    assert {r["doc_id"]: r["items"] for r in got.collect()} == {1: [5], 2: []}


# neighbours


def test_neighbours_exact_when_small(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(60, 6))
    rows = [(i, [float(v) for v in row], 0) for i, row in enumerate(x)]
    rows[5] = (5, rows[3][1], 0)
    rows += [(100, None, 0), (101, [0.0] * 6, 0), (102, [float("nan")] * 6, 0), (103, [1.0, None, 1.0, 1.0, 1.0, 1.0], 0), (104, [1.0], 0), (None, rows[0][1], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int")
    got = permutation_index.search(df, lambda i: i % 20 == 0).orderBy("query_id", "rank").collect()
    full = {i: np.array(v) for i, v, _ in rows[:60]}
    want = []
    for q in (0, 20, 40):
        top = sorted(((-float(full[q] @ full[i]), i) for i in full if i != q))[:20]
        want += [(q, r, i) for r, (_, i) in enumerate(top, 1)]
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in got] == want


def test_neighbour_ties_and_hot_files(spark, monkeypatch):
    """Binary vectors tie by the thousand; blocks of few vectors and queries give what one block gives."""
    monkeypatch.setattr(permutation_index, "CHUNK", 40)
    monkeypatch.setattr(permutation_index, "ASKS", 3)
    rng = np.random.default_rng(6)
    x = rng.integers(0, 2, size=(400, 10)).astype(float)
    x[:, 0] = 1
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "vec_id long, embedding array<float>")
    got = permutation_index.search(df, lambda i: i % 20 == 0, floor=400).orderBy("query_id", "rank").collect()
    want = [(q, r, int(i), float(x[q] @ x[i])) for q in range(0, 400, 20) for r, i in enumerate([i for i in np.lexsort((np.arange(400), -(x @ x[q]))) if i != q][:20], 1)]
    assert [tuple(r) for r in got] == want


def test_fewer_are_scored_than_there_are(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(2000, 8))
    unit = x[:128] / np.linalg.norm(x[:128], axis=1)[:, None]
    own = permutation_index.places(x, unit)
    assert (np.sort(own, axis=1) == np.arange(128)).all()
    apart = permutation_index.footrule(np.ascontiguousarray(own.T), own[7])
    assert apart.tolist() == [int(np.abs(o.astype(int) - own[7].astype(int)).sum()) for o in own]
    near = np.argsort(apart)[:200]  # the closest tenth by footrule holds nearly all of the nearest by cosine
    cosine = (x @ x[7]) / np.linalg.norm(x, axis=1)
    assert len(set(np.argsort(-cosine)[:20]) & set(near)) >= 18


def test_neighbours_recall_and_copies(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(3000, 16))
    x[100:400] = x[100]
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "vec_id long, embedding array<double>")
    got: dict[int, list[int]] = {}
    for r in permutation_index.search(df, lambda i: i % 20 == 0).collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    s = x @ x.T
    recall = []
    for q in range(0, 3000, 20):
        order = [i for i in np.lexsort((np.arange(3000), -s[q])) if i != q][:20]
        recall.append(len(set(order) & set(got[q])) / 20)
    assert np.mean(recall) >= 0.9
    assert sorted(got[120])[:3] == [100, 101, 102] or s[120].max() > s[120, 100]
    assert permutation_index.search(df.limit(0), lambda i: i % 20 == 0).count() == 0


def test_recall_holds_where_the_index_leaves_most_out(spark):
    """Vectors without structure, so many that most files are not probed; and copies of it in clusters, where few need be."""
    n = 20_000
    rng = np.random.default_rng(9)
    x = rng.normal(size=(n, 48)).astype(np.float32)
    df = spark.createDataFrame(pd.DataFrame({"vec_id": range(n), "embedding": x.tolist()}), "vec_id long, embedding array<float>")
    asked = range(0, n, 400)
    found: dict[int, list[int]] = {}
    for r in permutation_index.search(df, lambda i: i % 400 == 0).collect():
        found.setdefault(r["query_id"], []).append(r["vec_id"])
    hits = []
    for q in asked:
        s = x.astype(float) @ x[q].astype(float)
        s[q] = -np.inf
        hits.append(len(set(np.argsort(-s)[:20].tolist()) & set(found[q])) / 20)
    assert np.mean(hits) >= 0.9
    exact: dict[int, list[int]] = {}
    for r in permutation_index.search(df, lambda i: i % 4000 == 0, exact=True).orderBy("query_id", "rank").collect():
        exact.setdefault(r["query_id"], []).append(r["vec_id"])
    for q in range(0, n, 4000):
        s = x.astype(float) @ x[q].astype(float)
        assert exact[q] == [i for i in np.lexsort((np.arange(n), -s)).tolist() if i != q][:20]


def test_contamination_deep_in_a_very_long_text(spark):
    item = "when the river froze the miller walked across it with a lantern and two sacks of barley flour"
    rng = random.Random(8)
    filler = " ".join(f"w{rng.randrange(5000)}" for _ in range(150_000))
    docs = spark.createDataFrame([(1, f"{filler} {item} {filler}"), (2, filler)], "doc_id long, text string")
    got = {r["doc_id"]: r["items"] for r in decontaminate.contaminated(docs, spark.createDataFrame([(9, item)], "item_id long, text string")).collect()}
    assert got == {1: [9], 2: []}


@pytest.mark.parametrize("few", [0, 20_000])
def test_templates_against_brute_force(spark, monkeypatch, few):
    """Texts of one template with few words of their own: some link, most don't, and all share most shingles."""
    monkeypatch.setattr(jaccard_join, "FEW_POSTINGS", few)
    rng = random.Random(5)
    template = [f"c{i}" for i in range(60)]
    texts = []
    for i in range(260):
        w = template[:]
        for at in sorted(rng.sample(range(60), rng.choice([0, 1, 1, 2, 4])), reverse=True):
            w.insert(at, f"v{rng.randrange(12)}")
        texts.append(" ".join(w[: rng.choice([60, 62, 70])]))
    sets = [{" ".join(x) for x in zip(w, w[1:], w[2:], strict=False)} for w in (t.split() for t in texts)]
    root = list(range(len(texts)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in itertools.combinations(range(len(texts)), 2):
        if 100 * len(sets[i] & sets[j]) >= 90 * len(sets[i] | sets[j]):
            a, b = top(i), top(j)
            root[max(a, b)] = min(a, b)
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.link(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), k=3, percent=90).collect()}
    assert got == {i: top(i) for i in range(len(texts))} and 1 < len(set(got.values())) < 250
