"""Nearest neighbours by a permutation index.

A vector is represented by the order in which it sees the pivots. It is posted in the
inverted files of its nearest pivots; a query probes the files of more of its own. In a
file the posted permutations are ranked by footrule distance to the query's (the sum over
pivots of how far their places differ), and only vectors within the query's footrule limit
are scored, exactly, by inner product in double precision. The limit is the distance
within which a share of all vectors lie, read off a sample of permutations, so it is the
same in all files of a query.

How many files are probed and how large that share is, is measured: for a bounded sample of
queries the true neighbours are found by scoring all vectors, and both are set such that
``recall`` of those neighbours lie in probed files and within the limits. So recall does not
fall as the table grows; what a query costs depends on how much the order of pivots
says about nearness, little where vectors cluster, much where they have no structure. ``exact``
scores every vector instead, in blocks.

Equal vectors are indexed once, with their smallest ids: no more than k of them, and the
query itself, can be among the k nearest. A file with many vectors or many queries is
dealt out in blocks.
"""

from __future__ import annotations

import math
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from microveil.llm.shared import cut, scan_groups

#: Vectors and queries of a file that meet in one block.
CHUNK, ASKS = 8192, 16384


def places(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """For each vector the place of every pivot in its order by cosine, nearest first (ties: lower number)."""
    order = np.argsort(-(x @ pivots.T), axis=1, kind="stable")
    out = np.empty(order.shape, np.uint8)
    np.put_along_axis(out, order, np.broadcast_to(np.arange(order.shape[1], dtype=np.uint8), order.shape), 1)
    return out


def footrule(columns: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Footrule distances of one permutation to many; ``columns`` has a row per pivot."""
    own = own[:, None]
    return np.add.reduce(np.maximum(columns, own) - np.minimum(columns, own), axis=0, dtype=np.uint16)


def rows_of(column) -> np.ndarray:
    """A list column whose lists are equally long, as a matrix."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(flat.flatten()).reshape(len(flat), -1)


def _best_of(batches, asked, k: int):
    """Of each batch's vectors the k + 1 best of every asked one, with what the index says of them."""
    q = asked.value
    for b in batches:
        if not b.num_rows:
            continue
        x = rows_of(b.column(0)).astype(np.float64)
        for i, s in enumerate(q @ x.T):
            top = np.argpartition(-s, k)[: k + 1] if len(s) > k + 1 else np.arange(len(s))
            some = [b.column(c).take(pa.array(top)) for c in (1, 2, 3)]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(top), i, np.int32)), pa.array(s[top]), *some], names=["q", "s", "ids", "near", "places"])


def tuned(posted: DataFrame, asked: DataFrame, given, files: int, ranked: int, k: int, recall: float, trial: int) -> tuple[int, float]:
    """How many files to probe, and the share of all vectors within a query's limit, such that ``recall`` of true neighbours are found.

    The true neighbours of up to ``trial`` queries (the first by a hash) come from scoring all vectors; k + 1 a query reach the driver. Either bound
    alone lets through the root of ``recall``.
    """
    spark = posted.sparkSession
    sample = asked.select("v", F.col("ids")[0].alias("id")).orderBy(F.xxhash64("id"), "id").limit(trial).collect()
    if not sample:
        return 1, 1.0
    own = np.array([r["v"] for r in sample], np.float64)
    sent = spark.sparkContext.broadcast(own)
    best = posted.mapInArrow(partial(_best_of, asked=sent, k=k), "q int, s double, ids array<long>, near array<int>, places binary")
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("s"), F.col("ids")[0]))
    found = best.withColumn("r", rank).where(F.col("r") <= k + 1).collect()
    p, seen = given.value
    order = np.argsort(-(own @ p[:files].T), axis=1, kind="stable")
    at = np.empty_like(order)
    np.put_along_axis(at, order, np.broadcast_to(np.arange(files), order.shape), 1)
    mine, columns = places(own, p[:ranked]), np.ascontiguousarray(seen.T)
    apart = [np.sort(footrule(columns, m)) for m in mine]
    probes, shares = [], []
    for r in found:
        i = r["q"]
        if sample[i]["id"] in r["ids"] and len(r["ids"]) == 1:
            continue  # the query itself
        probes.append(int(at[i][r["near"]].min()) + 1)
        far = footrule(np.frombuffer(r["places"], np.uint8)[:, None], mine[i])[0]
        shares.append(np.searchsorted(apart[i], far, side="right") / len(seen))
    if not probes:
        return files, 1.0
    level = math.sqrt(recall)
    return int(np.quantile(probes, level, method="higher")), float(min(1.0, np.quantile(shares, level, method="higher") + 1 / len(seen)))


def _ordered(batches, given, files: int, ranked: int, width: int, sample: float | None):
    """Adds the nearest file pivots, the permutation of the ranking pivots, and for queries the footrule limit."""
    p, seen = given.value
    for b in batches:
        if not b.num_rows:
            continue
        x = rows_of(b.column(0)).astype(np.float64)
        near = np.argsort(-(x @ p[:files].T), axis=1, kind="stable")[:, :width].astype(np.int32)
        own = places(x, p[:ranked])
        limit = np.zeros(len(x), np.int32)
        if sample is not None:
            at = min(len(seen) - 1, math.ceil(sample * len(seen)))
            columns = np.ascontiguousarray(seen.T)
            limit = np.array([np.partition(footrule(columns, o), at)[at] for o in own], np.int32)
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(list(near), pa.list_(pa.int32())), pa.array([o.tobytes() for o in own], pa.binary()), pa.array(limit)], names=[*b.schema.names, "near", "places", "bound"])


def _file(t: pa.Table, k: int):
    """For each query of each block, its best k + 1 vectors (and those that tie) within the footrule limit."""
    key = np.stack([t[c].to_numpy() for c in ("p", "c", "o")])
    asks = np.asarray(t["asks"].to_numpy(zero_copy_only=False), bool)
    x = rows_of(t["v"]).astype(np.float64)
    own = np.frombuffer(b"".join(t["places"].to_pylist()), np.uint8).reshape(len(asks), -1)
    bound, ids = t["bound"].to_numpy(), t["ids"].combine_chunks()
    least = pa.compute.list_element(ids, 0).to_numpy()
    head = np.flatnonzero(np.concatenate(([True], (key[:, 1:] != key[:, :-1]).any(0))))
    q_out, rows_out, s_out = [], [], []
    for lo, hi in zip(head, [*head[1:], len(asks)], strict=True):
        q, d = lo + np.flatnonzero(asks[lo:hi]), lo + np.flatnonzero(~asks[lo:hi])
        if not len(q) or not len(d):
            continue
        columns, there = np.ascontiguousarray(own[d].T), x[d]
        for row in q:
            apart = footrule(columns, own[row])
            # a file gives k + 1 vectors at least, so a query finds k wherever there are as many
            far = max(int(bound[row]), int(np.partition(apart, k)[k]) if len(d) > k + 1 else 1 << 30)
            some = np.flatnonzero(apart <= far)
            near = there[some]
            if len(some) > k + 1:
                rough = near @ x[row]
                edge = np.partition(rough, len(rough) - k - 1)[len(rough) - k - 1]
                close = rough >= edge - 1e-9 * max(1.0, abs(edge))
                some, near = some[close], near[close]
            score = np.cumsum(near * x[row], axis=1)[:, -1]  # added in the order of components, whatever the block
            best = np.lexsort((least[d[some]], -score))[: k + 1]
            q_out.append(least[row])
            rows_out.append(d[some[best]])
            s_out.append(score[best])
    if q_out:
        at = pa.array(np.cumsum([0, *map(len, rows_out)]), pa.int32())
        named = ids.take(pa.array(np.concatenate(rows_out)))
        yield pa.RecordBatch.from_arrays([pa.array(q_out, pa.int64()), pa.ListArray.from_arrays(at, named), pa.ListArray.from_arrays(at, pa.array(np.concatenate(s_out)))], names=["q", "ids", "scores"])


def _merged(t: pa.Table, k: int):
    """The k best of all files of each query; whole queries, sorted by q."""
    ids, scores = t["ids"].combine_chunks(), t["scores"].combine_chunks()
    names = ids.flatten()
    each = pa.compute.list_value_length(names).to_numpy()
    found = names.flatten().to_numpy()
    q = np.repeat(np.repeat(t["q"].to_numpy(), pa.compute.list_value_length(ids).to_numpy()), each)
    s = np.repeat(scores.flatten().to_numpy(), each)
    order = np.lexsort((found, -s, q))
    q, found, s = q[order], found[order], s[order]
    # a vector found in several files has one score, so its copies adjoin
    keep = found != q
    keep[1:] &= (q[1:] != q[:-1]) | (found[1:] != found[:-1])
    q, found, s = q[keep], found[keep], s[keep]
    if not len(q):
        return
    head = np.flatnonzero(np.concatenate(([True], q[1:] != q[:-1])))
    rank = np.arange(len(q)) - np.repeat(head, np.diff(np.append(head, len(q)))) + 1
    top = rank <= k
    yield pa.RecordBatch.from_arrays([pa.array(q[top]), pa.array(rank[top].astype(np.int32)), pa.array(found[top]), pa.array(s[top])], names=["query_id", "rank", "vec_id", "score"])


def search(
    vectors: DataFrame,
    queries,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    k: int = 20,
    post: int = 6,
    recall: float = 0.93,
    floor: int = 64,
    ranked: int = 128,
    most_pivots: int = 16384,
    sample: int = 32768,
    trial: int = 128,
    sample_bytes: int = 64 << 20,
    exact: bool = False,
) -> DataFrame:
    """The k nearest found for each row that the condition ``queries`` on the id picks: query_id, rank, vec_id, score.

    Nearest is the largest inner product; ties go to the smaller id. Vectors that are null,
    all zero, or hold null, NaN or infinite components, vectors of a dimension other than the
    most common one, and rows with a null id take no part. Of rows that repeat an id the smallest
    vector counts. Every vector is posted in ``post`` files. What is fitted is a sample by hash of
    distinct vectors: sqrt(n) pivots (``most_pivots`` at most), of which the first ``ranked`` (256 at
    most) make the permutations, and 2 * sqrt(n) permutations (2,048 to ``sample``) for the
    footrule limits, all within ``sample_bytes``; and ``trial`` queries, by which the index is set to find ``recall`` of
    the neighbours (see ``tuned``). ``floor`` is the least number of vectors within a limit; k + 1 files are probed
    at least. With ``exact`` nothing is fitted and all vectors are scored.
    """
    spark = vectors.sparkSession
    element = next((f.dataType.elementType.simpleString() for f in vectors.schema if f.name == vector_col and f.dataType.typeName() == "array"), "double")
    kind = "float" if element == "float" else "double"
    v = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast(f"array<{kind}>").alias("v")).where("id IS NOT NULL AND v IS NOT NULL AND size(v) > 0")
    v = v.where("forall(v, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity')) AND exists(v, x -> x <> 0)")
    size = v.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if size is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    v = v.where(F.size("v") == size["n"]).groupBy("id").agg(F.min("v").alias("v"))
    v = v.withColumns({"h1": F.xxhash64("v"), "h2": F.hash("v")})
    # the k + 1 smallest ids of equal vectors; tasks drop the others before the shuffle
    some = v.withColumn("r", F.row_number().over(Window.partitionBy("h1", "h2").orderBy("id"))).where(F.col("r") <= k + 1)
    index = cut(some.groupBy("h1", "h2", "v").agg(F.sort_array(F.collect_list("id")).alias("ids")).select("v", "ids", "h1"))
    asking = v.where(queries(F.col("id"))).select("v", F.array("id").alias("ids"))
    n = index.count()
    fields = f"v array<{kind}>, ids array<long>, near array<int>, places binary, bound int"
    if exact:
        parts = max(1, -(-n // CHUNK))
        none = [F.lit(b"\0").alias("places"), F.lit(1 << 30).alias("bound")]
        posted = index.select("v", "ids", *none, F.pmod(F.xxhash64("ids"), F.lit(parts)).cast("int").alias("p"))
        asked = asking.select("v", "ids", *none, F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("p"))
    else:
        held = max(256, sample_bytes // (8 * size["n"]))  # vectors that come to the driver
        files = min(most_pivots, held, max(1, math.isqrt(n)))
        ranked = min(ranked, 256, n)
        seen = min(n, sample, held, max(2048, 2 * math.isqrt(n)))
        first = index.select("h1", "ids", "v").orderBy("h1", "ids").limit(max(files, ranked, seen)).select("v").toArrow()
        p = rows_of(first["v"]).astype(np.float64)
        unit = p[: max(files, ranked)]
        unit = unit / np.linalg.norm(unit, axis=1)[:, None]
        given = spark.sparkContext.broadcast((unit, places(p[:seen], unit[:ranked])))
        post = min(post, files)
        ordered = lambda rows, width, share: rows.mapInArrow(partial(_ordered, given=given, files=files, ranked=ranked, width=width, sample=share), fields)
        posted = cut(ordered(index.select("v", "ids"), post, None))
        probe, share = tuned(posted.select("v", "ids", "near", "places"), asking, given, files, ranked, k, recall, trial)
        probe, share = min(files, max(k + 1, probe)), min(1.0, max(floor / n, share))
        posted = posted.select("v", "ids", "places", "bound", F.explode("near").alias("p"))
        asked = ordered(asking, probe, share).select("v", "ids", "places", "bound", F.explode("near").alias("p"))
    blocks = lambda rows, most, name: rows.groupBy("p").agg(F.ceil(F.count("*") / most).cast("int").alias(name))
    sizes = cut(blocks(posted, CHUNK, "g").join(blocks(asked, ASKS, "a"), "p"))
    sizes = sizes if exact else F.broadcast(sizes)  # a row for each pivot, most_pivots at most
    own, every = lambda g: F.pmod(F.xxhash64("ids"), g).cast("int"), lambda g: F.explode(F.sequence(F.lit(0), F.col(g) - 1))
    dealt = posted.join(sizes, "p").withColumn("c", own("g")).withColumn("o", every("a")).withColumn("asks", F.lit(False))
    dealt = dealt.unionByName(asked.join(sizes, "p").withColumn("c", every("g")).withColumn("o", own("a")).withColumn("asks", F.lit(True))).drop("g", "a")
    found = dealt.repartition("p", "c", "o").sortWithinPartitions("p", "c", "o").mapInArrow(lambda bs: scan_groups(bs, ["p", "c", "o"], partial(_file, k=k), 1024), "q long, ids array<array<long>>, scores array<double>")
    return found.repartition("q").sortWithinPartitions("q").mapInArrow(lambda bs: scan_groups(bs, ["q"], partial(_merged, k=k), 2048), "query_id long, rank int, vec_id long, score double")
