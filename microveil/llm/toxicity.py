"""Toxic spans by a linear-chain conditional random field.

Learning, on a bounded sample of labelled documents: tokens are labelled from the
documents' labels, a token counting as toxic where its word, or a prefix of it, occurs
in toxic documents far more often than chance allows (a likelihood-ratio test over
documents without near copies); the chain's weights (hashed word, prefix and suffix
features, a bias and the transitions) are then fitted to all labelled tokens of the
sample's sentences by gradient ascent on the conditional likelihood; last, two sums of
the marginals are calibrated to document labels by logistic regression.

Scoring: chains are sentences, of any length. Forward and backward messages of two states
are one ratio each, and a step is a 2 x 2 matrix; chains are worked on in pieces of
``CHAIN`` tokens, all pieces of about a length together, after products of the matrices have
carried the messages from piece to piece. Every word of every text is scored; cost is
linear in bytes.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from microveil.llm import textscan as T
from microveil.llm.shared import held_out, small_batches, training_rows, training_texts

#: Tokens that are stepped through at once; results do not depend on it.
CHAIN = 64
#: Tokens of pieces of about a length that are worked on together.
TOGETHER = 1 << 17
BITS = 18
FEATURES = 6
#: How many words may be labelled by chance, and the share of the statistic's largest value that is enough whatever the chance.
BY_CHANCE, ENOUGH = 1e-3, 0.35

_letters = np.ones(256, bool)  # separators
_letters[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
_stops = np.zeros(256, bool)
_stops[[10, 13, 33, 46, 59, 63]] = True


def fold_case(data: np.ndarray) -> np.ndarray:
    """ASCII and Latin-1 capitals in lower case, byte for byte."""
    out = T.LOWER[data]
    if len(out) > 1:
        capital = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        out[1:][capital] += 0x20
    return out


def token_features(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """FEATURES 64-bit hashes for each token: the word, prefixes of 3, 4, 5 and 6 bytes, suffix of 4."""
    p, inv = T.powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(T.BYTE_CODES[data] * p[:-1], out=total[1:])
    out = np.empty((FEATURES, len(start)), np.uint64)
    spans = [(start, end), *((start, np.minimum(end, start + k)) for k in (3, 4, 5, 6)), (np.maximum(start, end - 4), end)]
    for j, (a, b) in enumerate(spans):
        out[j] = T.mix((total[b] - total[a]) * inv[a] + np.uint64(j << 20) + (b - a).astype(np.uint64))
    return out


def chains(data: np.ndarray, start: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First token and length of every chain: sentences within texts."""
    n = len(start)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    stops = np.cumsum(_stops[data])
    begins = np.zeros(n, bool)
    begins[0] = True
    begins[1:] = stops[start[1:]] > stops[start[:-1]]
    begins[first[:-1][first[:-1] < n]] = True
    head = np.flatnonzero(begins)
    return head, np.diff(np.append(head, n))


def pieces(head: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, ...]:
    """Chains in pieces of up to CHAIN tokens: first token, length, number in the chain, whether it is the chain's last."""
    count = -(-length // CHAIN)
    chain = np.repeat(np.arange(len(head)), count)
    number = np.arange(len(chain)) - np.repeat(np.cumsum(count) - count, count)
    return head[chain] + number * CHAIN, np.minimum(CHAIN, length[chain] - number * CHAIN), number, number == count[chain] - 1


def carried(e: np.ndarray, head: np.ndarray, length: np.ndarray, number: np.ndarray, last: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each piece the forward odds at the end of the piece before it, and the backward message at its own end."""
    came, after = np.ones(len(head)), np.ones(len(head))
    long = np.flatnonzero(~last | (number > 0))
    if not len(long):
        return came, after
    ahead = np.broadcast_to(np.eye(2), (len(long), 2, 2)).copy()  # of all tokens of a piece but a chain's first
    back = ahead.copy()
    for j in range(CHAIN):
        at = np.flatnonzero(length[long] > j)
        x = e[head[long[at]] + j]
        one, zero = np.full_like(x, t[1, 0]), np.full_like(x, t[0, 0])
        step = np.stack((np.stack((x * t[1, 1], x * t[0, 1]), -1), np.stack((one, zero), -1)), -2)
        use = at[(number[long[at]] > 0) | (j > 0)]
        ahead[use] = step[np.isin(at, use)] @ ahead[use]
        ahead[use] /= ahead[use].max((1, 2), keepdims=True)
        step = np.stack((np.stack((x * t[1, 1], one), -1), np.stack((x * t[0, 1], zero), -1)), -2)
        back[at] = back[at] @ step
        back[at] /= back[at].max((1, 2), keepdims=True)
    through = lambda m, r: (m[:, 0, 0] * r + m[:, 0, 1]) / (m[:, 1, 0] * r + m[:, 1, 1])
    place = np.full(len(head), -1)
    place[long] = np.arange(len(long))
    order = np.argsort(number[long], kind="stable")
    edge = np.searchsorted(number[long][order], np.arange(number.max() + 2))
    for k in range(number.max()):
        now = long[order[edge[k] : edge[k + 1]]]
        now = now[~last[now]]
        came[now + 1] = through(ahead[place[now]], e[head[now]] if k == 0 else came[now])
    for k in range(number.max(), 0, -1):
        now = long[order[edge[k] : edge[k + 1]]]
        after[now - 1] = through(back[place[now]], after[now])
    return came, after


def marginals(score: np.ndarray, head: np.ndarray, length: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, float, np.ndarray]:
    """Probability of state 1 of every token; also the summed log partition function and the expected transitions.

    ``score`` is the weight of state 1 less that of state 0; ``trans`` the log weights of the steps.
    """
    out = np.zeros(len(score))
    t = np.exp(trans)
    log_z, steps = 0.0, np.zeros((2, 2))
    e = np.exp(np.clip(score, -30, 30))
    begin, size, number, last = pieces(head, length)
    came, after = carried(e, begin, size, number, last, t)
    edge, groups = 1, []
    while edge <= 2 * CHAIN:
        some = np.flatnonzero((size <= edge) & (size > edge // 2))
        rows = max(1, TOGETHER // edge)
        groups += [some[i : i + rows] for i in range(0, len(some), rows)]
        edge *= 2
    for mine in groups:
        n, most, first, r = size[mine], int(size[mine].max()), number[mine] == 0, came[mine]
        at = begin[mine] + np.arange(most)[:, None]
        real = np.arange(most)[:, None] < n
        em = np.where(real, e[np.minimum(at, len(e) - 1)], 0.0)
        ahead = np.empty((most, len(mine)))  # forward odds
        back = np.empty((most, len(mine)))
        zero, one_ = np.where(first, 1.0, t[0, 0] + t[1, 0] * r), np.where(first, 1.0, t[0, 1] + t[1, 1] * r)
        ahead[0] = em[0] * one_ / zero
        log_z += np.log((zero + em[0] * one_) / np.where(first, 1.0, 1 + r)).sum()
        for j in range(1, most):
            r = ahead[j - 1]
            zero, one_ = t[0, 0] + t[1, 0] * r, t[0, 1] + t[1, 1] * r
            ahead[j] = em[j] * one_ / zero
            log_z += (np.log((zero + em[j] * one_) / (1 + r)) * real[j]).sum()
        back[most - 1] = after[mine]
        for j in range(most - 2, -1, -1):
            b = em[j + 1] * back[j + 1]
            back[j] = np.where(real[j + 1], (t[1, 0] + t[1, 1] * b) / (t[0, 0] + t[0, 1] * b), after[mine])
        odds = ahead * back
        out[at[real]] = (odds / (1 + odds))[real]
        b, r = em * back, np.concatenate((came[mine][None], ahead[:-1]))
        w = np.stack((np.broadcast_to(t[0, 0], b.shape), t[0, 1] * b, t[1, 0] * r, t[1, 1] * r * b))
        real[0] &= ~first  # a chain's first token has no step
        steps += ((w / w.sum(0)) * real).sum((1, 2)).reshape(2, 2)
    return out, log_z, steps


def scanned(data: np.ndarray, off: np.ndarray):
    low = fold_case(data)
    start, end, first = T.words(low, off, _letters)
    return start, end, first, token_features(low, start, end), *chains(data, start, first)


def buffer_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    raw = [t.encode("utf-8", "replace") for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate(([0], np.cumsum([len(r) for r in raw]))).astype(np.int64)


def distinct_texts(word: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Texts without near copies among earlier ones: two of eight minimum hashes of word pairs agree with none."""
    seen: set[tuple[int, int]] = set()
    keep = np.zeros(len(first) - 1, bool)
    for i in range(len(keep)):
        w = word[first[i] : first[i + 1]]
        if len(w) < 2:
            keep[i] = len(w) > 0
            continue
        pair = T.mix(w[:-1] + w[1:] * np.uint64(3))
        low = [int(T.mix(pair ^ np.uint64(0x9E3779B97F4A7C15 * (j + 1) & T.MASK)).min()) for j in range(8)]
        keys = {(j, hash((low[j], low[j + 1]))) for j in range(0, 8, 2)}
        keep[i] = not keys & seen
        seen |= keys
    return keep


def document_sums(m: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each text: the largest log odds of a token, and the log of one plus the sum of its marginals over one half."""
    logit = np.clip(np.log(np.maximum(m, 1e-9) / np.maximum(1 - m, 1e-9)), -12, 12)
    out = np.zeros((len(first) - 1, 2))
    out[:, 0] = -12
    some = first[:-1] < first[1:]
    if some.any():
        at = first[:-1][some]
        out[some, 0] = np.maximum.reduceat(logit, at)
        out[some, 1] = np.log1p(np.add.reduceat(np.where(m >= 0.5, m, 0.0), at))
    return out


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-4) -> np.ndarray:
    """Weights (bias last) by Newton steps."""
    x = np.column_stack((x, np.ones(len(x))))
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + ridge * len(x) / 100 * np.eye(len(w))
        w = w - np.linalg.solve(h, x.T @ (p - y) + ridge * len(x) / 100 * w)
    return w


def least_statistic(words: int, toxic: float, clean: float) -> float:
    """What a word's likelihood ratio must exceed to be labelled.

    Either so much that less than ``BY_CHANCE`` of so many ``words`` exceed it by chance (a chi-square quantile), or, where the
    documents are too few for that, a share of what a word in all toxic and no clean ones has.
    """
    bound = 2 * np.log(max(words, 2) / BY_CHANCE)
    return float(min(bound - np.log(bound) - np.log(np.pi), ENOUGH * 2 * toxic * np.log((toxic + clean) / toxic)))


def fit(texts: list[str], labels: list[int], rounds: int = 50, clean_tokens: int = 200_000) -> dict | None:
    """The model, or None where no text of label 1 or none of label 0 is left, or none of label 1 has a word.

    Words are labelled by ``least_statistic``; if none gets so far, those that come nearest are. Of sentences without a toxic word, a sample of ``clean_tokens`` words from clean texts and
    half as many from toxic ones is learned from.
    """
    if len(set(labels)) < 2:
        return None
    n_tokens, firsts, parts, heads, lengths = 0, [np.zeros(1, np.int64)], [], [], []
    for i in range(0, len(texts), 100):  # powers and sums are as long as the bytes scanned at once
        _, _, some, hashes, begin, size = scanned(*buffer_of(texts[i : i + 100]))
        firsts.append(some[1:] + n_tokens)
        heads.append(begin + n_tokens)
        lengths.append(size)
        parts.append(hashes)
        n_tokens += hashes.shape[1]
    first, head, length = np.concatenate(firsts), np.concatenate(heads), np.concatenate(lengths)
    feats = [np.concatenate([p[j] for p in parts]) for j in range(FEATURES)]
    del parts
    keep = distinct_texts(feats[0], first)
    y = np.array(labels)
    owner = np.repeat(np.arange(len(texts)), np.diff(first))
    total = np.array([(keep & (y == c)).sum() for c in (0, 1)], float)
    if not total.all():
        return None
    toxic, best = np.zeros(n_tokens, bool), (-1.0, None)
    for j in range(FEATURES - 1):  # suffixes describe but do not label
        name, at = np.unique(feats[j], return_inverse=True)
        docs = np.unique((at * len(texts) + owner)[keep[owner]])  # one entry for each word and text
        one = y[docs % len(texts)] == 1
        a = np.bincount(docs[one] // len(texts), minlength=len(name)).astype(float)
        b = np.bincount(docs[~one] // len(texts), minlength=len(name)).astype(float)
        share = (a + b) / total.sum()
        with np.errstate(divide="ignore", invalid="ignore"):
            g = 2 * (np.where(a > 0, a * np.log(a / (total[1] * share)), 0) + np.where(b > 0, b * np.log(b / (total[0] * share)), 0))
        more = a / total[1] > b / total[0]
        limit = least_statistic(int((a + b > 1).sum()), total[1], total[0])
        strong = (g > limit) & (a / total[1] > 8 * (b + 0.5) / total[0])
        toxic |= strong[at]
        top = np.where(more, g, -1.0)
        if len(top) and top.max() > best[0]:
            best = (float(top.max()), (top == top.max())[at])
    if not toxic.any() and best[1] is not None:
        toxic = best[1]
    toxic &= y[owner] == 1
    hot = np.add.reduceat(toxic.astype(np.int64), head) > 0 if len(head) else np.zeros(0, bool)
    rest = np.flatnonzero(~hot & keep[owner[head]] & (y[owner[head]] == 0))
    near = np.flatnonzero(~hot & keep[owner[head]] & (y[owner[head]] == 1))
    rng = np.random.default_rng(0)
    some = lambda c, most: (c := rng.permutation(c))[np.cumsum(length[c]) <= most]
    use = np.concatenate((np.flatnonzero(hot & keep[owner[head]]), some(rest, clean_tokens), some(near, clean_tokens // 2)))
    if not hot.any():
        return None
    tokens = np.concatenate([np.arange(head[c], head[c] + length[c]) for c in use])
    n = length[use]
    h = np.concatenate(([0], np.cumsum(n)))[:-1]
    slot = [(f[tokens] >> np.uint64(64 - BITS)).astype(np.int32) for f in feats]
    gold = toxic[tokens].astype(float)
    inner = np.ones(len(tokens), bool)
    inner[h] = False
    before = np.concatenate(([0], gold[:-1]))
    seen = np.array([[((before == i) & (gold == k) & inner).sum() for k in (0, 1)] for i in (0, 1)], float)
    w, bias, trans = np.zeros(1 << BITS), -3.0, np.zeros((2, 2))
    m1, m2 = [np.zeros_like(w), 0.0, np.zeros((2, 2))], [np.zeros_like(w), 0.0, np.zeros((2, 2))]
    scale = 1.0 / max(1.0, gold.sum())
    for step in range(1, rounds + 1):
        p, _, steps = marginals(sum(w[x] for x in slot) + bias, h, n, trans)
        miss = (gold - p) * scale
        grads = [sum(np.bincount(x, miss, minlength=len(w)) for x in slot) - 1e-5 * w, miss.sum(), (seen - steps) * scale - 1e-3 * trans]
        new = []
        for j, (value, g) in enumerate(zip((w, bias, trans), grads, strict=True)):
            m1[j], m2[j] = 0.8 * m1[j] + 0.2 * g, 0.95 * m2[j] + 0.05 * g * g
            new.append(value + 0.25 * (m1[j] / (1 - 0.8**step)) / (np.sqrt(m2[j] / (1 - 0.95**step)) + 1e-7))
        w, bias, trans = new
    model = {"w": w.astype(np.float32), "bias": float(bias), "trans": trans}
    p = marginals(sum(model["w"][(f >> np.uint64(64 - BITS)).astype(np.int32)] for f in feats) + bias, head, length, trans)[0]
    model["out"] = logistic(document_sums(p, first)[keep], y[keep])
    return model


def _score(batches, shared, threshold: float, with_spans: bool):
    model = shared.value
    names = ["score", "spans"]
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    for b in batches:
        scores, spans = [], []
        for first_row, last_row, data, off in T.chunks(b.column(0)):
            rows = last_row - first_row
            if model is None:
                scores.append(np.zeros(rows))
                spans += [[] for _ in range(rows)]
                continue
            start, end, first, feats, head, length = scanned(data, off)
            s = np.full(len(start), model["bias"])
            for f in feats:
                s += model["w"][(f >> np.uint64(64 - BITS)).astype(np.int64)]
            m = marginals(s, head, length, model["trans"])[0]
            sums = document_sums(m, first)
            scores.append(1 / (1 + np.exp(-np.clip(sums @ model["out"][:-1] + model["out"][-1], -30, 30))))
            mine: list[list] = [[] for _ in range(rows)]
            if with_spans:
                chars = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
                hit = np.flatnonzero(m >= 0.5)
                for t, d in zip(hit.tolist(), (np.searchsorted(first, hit, side="right") - 1).tolist(), strict=True):
                    x, y = int(chars[start[t]] - chars[off[d]]), int(chars[end[t]] - chars[off[d]])
                    if mine[d] and mine[d][-1]["token"] == t - 1:
                        mine[d][-1].update(end=y, token=t)
                    else:
                        mine[d].append({"start": x, "end": y, "token": t})
            spans += [[{"start": z["start"], "end": z["end"]} for z in v] for v in mine]
        if scores:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(scores)), pa.array(spans, kind), *(b.column(j) for j in range(1, b.num_columns))], names=[*names, *b.schema.names[1:]])


def tag(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "toxic", folds: int = 4, fold: int = 2, per_class: int = 1200, most_bytes: int = 12_000_000, clean_tokens: int = 200_000, threshold: float = 0.3, spans: bool = True) -> DataFrame:
    """``docs`` with ``held_out``, ``score`` (0 to 1), ``predicted`` and ``spans`` (character offsets of toxic words that adjoin).

    Learns from at most ``per_class`` labelled documents of either class and ``most_bytes`` of
    text, of which sentences without toxic words give up to ``clean_tokens`` (see ``fit``), never from those
    held out. Null and empty texts have no words and get the score of a text without a toxic
    word; with no text of one class to learn from, or no word in those of label 1, all scores are 0. With few
    labels, fewer toxic documents are found: words count as toxic as far as the sample bears it out. Every row is scored on
    its own, so repeated rows and ids and null ids are allowed. Columns of the new names
    are replaced.
    """
    spark = docs.sparkSession
    small_batches(spark)
    base = docs.drop("held_out", "score", "predicted", "spans")
    model = spark.sparkContext.broadcast(fit(*training_texts(training_rows(docs, labels, label, folds, fold, per_class, id_col, text_col), most_bytes), clean_tokens=clean_tokens))
    names = [f"_c{i}" for i in range(len(base.columns))]
    rows = base.toDF(*names).select(F.coalesce(F.col(names[base.columns.index(text_col)]).cast("string"), F.lit("")).alias("_t"), *names)
    fields = ", ".join(f"{n} {f.dataType.simpleString()}" for n, f in zip(names, base.schema, strict=True))
    out = rows.mapInArrow(partial(_score, shared=model, threshold=threshold, with_spans=spans), f"score double, spans array<struct<start:int,end:int>>, {fields}")
    out = out.select(*[F.col(n).alias(f.name) for n, f in zip(names, base.schema, strict=True)], "score", "spans")
    return out.select(*base.columns, held_out(id_col, folds, fold).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "spans")
