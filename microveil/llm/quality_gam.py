"""Document quality by a generalised additive model with pairwise interactions.

Features of a text are shares and counts that do not depend on its language. Each is cut
into bins at quantiles of a bounded sample of labelled documents. Shallow trees over one
feature's bins are boosted in turn, feature after feature, on the logistic loss; their sums
are one lookup table per feature. Then the pairs whose tables of residuals gain most get
trees of two splits in the same way. A score is the sum of one table entry for each
feature and pair: bin numbers and additions over whole batches.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from microveil.llm import textscan as T
from microveil.llm.shared import held_out, small_batches, training_rows

BINS, PAIR_BINS, PAIRS = 32, 8, 8

_classes = {
    "upper": [*range(65, 91)], "digit": [*range(48, 58)], "symbol": [c for c in range(33, 127) if chr(c) in "#$%&*+<=>@[\\]^_`{|}~"], "bar": [124],
    "mark": [33], "stop": [46], "comma": [44], "newline": [10], "wide": [*range(128, 256)],
}
CLASSES = np.zeros((len(_classes), 256), bool)
for _i, _v in enumerate(_classes.values()):
    CLASSES[_i, _v] = True
NAMES = ["words", "bytes", "word_bytes", *_classes, "latin_upper", "distinct", "distinct_pairs", "top_share", "repeats", "longest_run", "line_words"]


def features(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """One row per text, one column for each of NAMES; an empty text has zeros."""
    n = len(off) - 1
    start, end, first = T.words(data, off)
    size, count = np.diff(off).astype(float), np.diff(first).astype(float)
    sure, some = np.maximum(size, 1), np.maximum(count, 1)
    h = T.span_hashes(data, start, end)
    out = [np.log1p(count), np.log1p(size), size / some]
    newlines = None
    for name, table in zip(_classes, CLASSES, strict=True):
        total = np.concatenate(([0], np.cumsum(table[data], dtype=np.int64)))
        hits = (total[off[1:]] - total[off[:-1]]).astype(float)
        if name == "newline":
            newlines = hits
        out.append(hits / sure)
    latin = np.zeros(len(data), bool)
    if len(data) > 1:
        latin[1:] = (data[:-1] == 0xC3) & (data[1:] <= 0x9E)
    total = np.concatenate(([0], np.cumsum(latin, dtype=np.int64)))
    out.append((total[off[1:]] - total[off[:-1]]) / sure)
    rest = np.zeros((n, 5))
    for i in range(n):
        w = h[first[i] : first[i + 1]]
        if not len(w):
            continue
        _, c = np.unique(w, return_counts=True)
        same = w[1:] == w[:-1]
        pairs = len(np.unique(w[:-1] * np.uint64(3) + w[1:])) / (len(w) - 1) if len(w) > 1 else 1.0
        breaks = np.flatnonzero(np.concatenate(([True], ~same, [True])))
        rest[i] = len(c) / len(w), pairs, c.max() / len(w), same.mean() if len(same) else 0.0, np.log1p(np.diff(breaks).max())
    out += [*rest.T, count / (newlines + 1)]
    return np.column_stack(out)


def tree(g: np.ndarray, h: np.ndarray, leaves: int = 3) -> np.ndarray:
    """Leaf values, bin by bin, of the best tree of up to ``leaves`` leaves over ordered bins with gradients g and weights h."""
    cuts = [0, len(g)]
    a, b = np.concatenate(([0.0], np.cumsum(g))), np.concatenate(([0.0], np.cumsum(h)))
    worth = lambda x, y: (a[y] - a[x]) ** 2 / (b[y] - b[x] + 1.0)
    for _ in range(leaves - 1):
        best = (1e-9, None)
        for x, y in zip(cuts, cuts[1:], strict=False):
            if y - x > 1:
                s = np.arange(x + 1, y)
                gain = worth(x, s) + worth(s, y) - worth(x, y)
                j = int(gain.argmax())
                best = max(best, (float(gain[j]), int(s[j])), key=lambda z: z[0])
        if best[1] is None:
            break
        cuts = sorted([*cuts, best[1]])
    out = np.zeros(len(g))
    for x, y in zip(cuts, cuts[1:], strict=False):
        out[x:y] = (a[y] - a[x]) / (b[y] - b[x] + 1.0)
    return out


def quadrants(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and leaf values of the best split of a table into four quadrants."""
    a, b = np.pad(g, ((1, 0), (1, 0))).cumsum(0).cumsum(1), np.pad(h, ((1, 0), (1, 0))).cumsum(0).cumsum(1)
    n, m = g.shape
    best = (0.0, np.zeros_like(g))
    for i in range(1, n):
        for j in range(1, m):
            parts = [(slice(0, i), slice(0, j), a[i, j], b[i, j]), (slice(0, i), slice(j, m), a[i, m] - a[i, j], b[i, m] - b[i, j]), (slice(i, n), slice(0, j), a[n, j] - a[i, j], b[n, j] - b[i, j]), (slice(i, n), slice(j, m), a[n, m] - a[i, m] - a[n, j] + a[i, j], b[n, m] - b[i, m] - b[n, j] + b[i, j])]
            gain = sum(s * s / (t + 1.0) for *_, s, t in parts)
            if gain > best[0]:
                leaf = np.zeros_like(g)
                for x, y, s, t in parts:
                    leaf[x, y] = s / (t + 1.0)
                best = (gain, leaf)
    return best


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 120, pair_rounds: int = 30, rate: float = 0.15) -> dict | None:
    """The model of features x (a row per text) and labels y, or None where a class is missing."""
    if len(set(y.tolist())) < 2:
        return None
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
    bins = [np.searchsorted(e, c, side="right") for e, c in zip(edges, x.T, strict=True)]
    tables = [np.zeros(len(e) + 1) for e in edges]
    bias = float(np.log(y.mean() / (1 - y.mean())))
    f = np.full(len(y), bias)
    for _ in range(rounds):
        for j, at in enumerate(bins):
            p = sigmoid(f)
            step = rate * tree(np.bincount(at, y - p, len(tables[j])), np.bincount(at, p * (1 - p), len(tables[j])))
            tables[j] += step
            f += step[at]
    coarse = [np.unique(np.quantile(c, np.linspace(0, 1, PAIR_BINS + 1)[1:-1])) for c in x.T]
    low = [np.searchsorted(e, c, side="right") for e, c in zip(coarse, x.T, strict=True)]

    def table(i, j, v):
        m = len(coarse[j]) + 1
        return np.bincount(low[i] * m + low[j], v, (len(coarse[i]) + 1) * m).reshape(-1, m)

    p = sigmoid(f)
    gains = sorted(((quadrants(table(i, j, y - p), table(i, j, p * (1 - p)))[0], i, j) for i in range(len(low)) for j in range(i)), reverse=True)[:PAIRS]
    pairs = {(i, j): np.zeros((len(coarse[i]) + 1, len(coarse[j]) + 1)) for _, i, j in gains}
    for _ in range(pair_rounds):
        for i, j in pairs:
            p = sigmoid(f)
            step = rate * quadrants(table(i, j, y - p), table(i, j, p * (1 - p)))[1]
            pairs[i, j] += step
            f += step[low[i], low[j]]
    return {"bias": bias, "edges": edges, "tables": tables, "coarse": coarse, "pairs": pairs}


def scores(model: dict, x: np.ndarray) -> np.ndarray:
    f = np.full(len(x), model["bias"])
    for c, e, t in zip(x.T, model["edges"], model["tables"], strict=True):
        f += t[np.searchsorted(e, c, side="right")]
    for (i, j), t in model["pairs"].items():
        f += t[np.searchsorted(model["coarse"][i], x[:, i], side="right"), np.searchsorted(model["coarse"][j], x[:, j], side="right")]
    return sigmoid(f)


def _described(batches):
    """Features of each text."""
    for b in batches:
        for first, last, data, off in T.chunks(b.column(2)):
            yield pa.RecordBatch.from_arrays([b.column(j).slice(first, last - first) for j in (0, 1)] + [pa.array(list(features(data, off)), pa.list_(pa.float64()))], names=["_id", "_y", "x"])


def _score(batches, shared):
    model = shared.value
    for b in batches:
        out = []
        for first, last, data, off in T.chunks(b.column(0)):
            out.append(scores(model, features(data, off)) if model is not None else np.zeros(last - first))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out)), *(b.column(j) for j in range(1, b.num_columns))], names=["score", *b.schema.names[1:]])


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "quality", folds: int = 5, fold: int = 0, per_class: int = 2500, threshold: float = 0.3) -> DataFrame:
    """``docs`` with ``held_out``, ``score`` (0 to 1) and ``predicted``; columns of these names are replaced.

    Learns from at most ``per_class`` labelled documents of either class, never from those
    held out. Null and empty texts are scored by their features, all zero. With no text of
    one class to learn from, all scores are 0. Every row is scored on its own, so repeated
    rows and ids and null ids are allowed.
    """
    small_batches(docs.sparkSession)
    base = docs.drop("held_out", "score", "predicted")
    learn = training_rows(docs, labels, label, folds, fold, per_class, id_col, text_col).select("_id", "_y", "_text").mapInArrow(_described, "_id long, _y int, x array<double>")
    # numbers only come to the driver: one row of features an id, equal ones once
    rows = learn.groupBy("_id").agg(F.max("_y").alias("y"), F.min("x").alias("x")).groupBy("x").agg(F.max("y").alias("y"), F.min("_id").alias("i")).orderBy("i").collect()
    model = docs.sparkSession.sparkContext.broadcast(fit(np.array([r["x"] for r in rows]), np.array([r["y"] for r in rows], float)))
    names = [f"_c{i}" for i in range(len(base.columns))]
    rows = base.toDF(*names).select(F.coalesce(F.col(names[base.columns.index(text_col)]).cast("string"), F.lit("")).alias("_t"), *names)
    fields = ", ".join(f"{n} {f.dataType.simpleString()}" for n, f in zip(names, base.schema, strict=True))
    out = rows.mapInArrow(partial(_score, shared=model), f"score double, {fields}")
    out = out.select(*[F.col(n).alias(f.name) for n, f in zip(names, base.schema, strict=True)], "score")
    return out.select(*base.columns, held_out(id_col, folds, fold).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
