"""Checkpoints, balanced group scans and connected components for the operators."""

from __future__ import annotations

import itertools
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """What spark.checkpoint.dir names, which the driver and all executors share.

    Where it is unset, a local session (one machine, as in tests) gets a temporary folder; on a
    cluster that is an error, as executors could not read each other's folders.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if context.getCheckpointDir() is None:
        if not named and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints"))
    return named or context.getCheckpointDir()


def numbered(df: DataFrame, *columns: str) -> tuple:
    """The frame with columns c0, c1, ..., and what ``columns`` are called in it."""
    names = [f"c{i}" for i in range(len(df.columns))]
    return df.toDF(*names), *[names[df.columns.index(c)] for c in columns]


def small_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Texts are long: an Arrow batch of them has no more than so many rows, unless the session asks for fewer."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def cut(df: DataFrame) -> DataFrame:
    """Materialise in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def scan_groups(batches: Iterator[pa.RecordBatch], keys: list[str], work: Callable, least: int = 8192, of: Callable = lambda k: k, most: int | None = None) -> Iterator[pa.RecordBatch]:
    """Feed ``work`` with tables of whole groups from batches that are sorted by ``keys``.

    Small groups come together, at least ``least`` rows at a time. A group is never cut, so
    the caller bounds its size beforehand, or sets ``most``: then ``work`` gets a second
    argument, and a group of more rows comes in parts, each on its own with True. ``of`` maps
    a key column to what groups go by.
    """
    held: list[pa.RecordBatch] = []
    rows, part = 0, None
    call = (lambda t, cut_up=False: work(t, cut_up)) if most else (lambda t, cut_up=False: work(t))
    columns = lambda t: [of(t[k].to_numpy()) for k in keys]

    def led(whole: pa.Table):
        """Hands on what continues the group that is being cut; the rest."""
        other = np.flatnonzero(np.any([c != p for c, p in zip(columns(whole), part, strict=True)], axis=0))
        at = int(other[0]) if len(other) else whole.num_rows
        return whole.slice(0, at), whole.slice(at)

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows < least:
            continue
        whole = pa.Table.from_batches(held).combine_chunks()
        if part is not None:
            lead, whole = led(whole)
            if lead.num_rows:
                yield from call(lead, True)
            if not whole.num_rows:
                held, rows = [], 0
                continue
            part = None
        cols = columns(whole)
        other = np.flatnonzero(np.any([c != c[-1] for c in cols], axis=0))
        at = int(other[-1]) + 1 if len(other) else 0
        if at:
            yield from call(whole.slice(0, at))
        held, rows = whole.slice(at).to_batches(), whole.num_rows - at
        if most and rows >= most:
            part = [c[-1] for c in cols]
            yield from call(whole.slice(at), True)
            held, rows = [], 0
    if rows:
        whole = pa.Table.from_batches(held).combine_chunks()
        if part is not None:
            lead, whole = led(whole)
            if lead.num_rows:
                yield from call(lead, True)
        if whole.num_rows:
            yield from call(whole)


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of the undirected edges (a, b): one row per node, with its smallest reachable node.

    Alternates two steps until nothing changes: every larger neighbour of a node is
    pointed to the node's smallest neighbour, then every smaller one is. Both are joins
    and aggregates, a few of them in the logarithm of the longest path. Self-loops and
    repeated edges are allowed; an empty input gives an empty result.
    """
    e = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    for _ in range(rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u"), F.least("u", "m").alias("m"))
        e = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = e.groupBy("u").agg(F.min("v").alias("m"))
        e = e.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        e = cut(e)
        now = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("s")).first()
        if before == now:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def held_out(id_col: str, folds: int, fold: int):
    """Whether crc32 of the id as text falls on the fold that is not learned from; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % folds == fold, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, folds: int, fold: int, per_class: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_id, _y, _text) to learn from: of either class up to ``per_class`` labelled ids that are not held out, all their rows.

    The ids are the first by a hash of the id, so the sample is the same in every run and
    its size has a bound. An id with both labels counts as 1. Ids that are null or have no
    document and labels that are null take no part.
    """
    seen = labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col, folds, fold)).groupBy(F.col(id_col).cast("long").alias("_id")).agg(F.max(F.col(label).cast("int")).alias("_y"))
    chosen = None
    for y in (0, 1):
        part = seen.where(F.col("_y") == y).orderBy(F.xxhash64("_id"), "_id").limit(per_class)
        chosen = part if chosen is None else chosen.unionByName(part)
    return docs.select(F.col(id_col).cast("long").alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text")).join(F.broadcast(chosen), "_id")


def training_texts(rows: DataFrame, most_bytes: int) -> tuple[list[str], list[int]]:
    """Texts and labels of ``training_rows``, one text an id, equal texts once, of ``most_bytes`` in UTF-8 altogether.

    Sizes are looked at first: of either class in turn, ids follow by hash as long as the
    whole text still fits. So what comes to the driver has a bound, and no text is cut.
    """
    spark = rows.sparkSession
    sizes = rows.select("_id", "_y", F.struct(F.xxhash64("_text").alias("h"), F.octet_length("_text").alias("n")).alias("t"))
    known = sizes.groupBy("_id").agg(F.max("_y").alias("y"), F.min("t").alias("t")).select("_id", "y", "t.h", "t.n", F.xxhash64("_id").alias("o")).collect()
    turn = {0: [], 1: []}
    for r in sorted(known, key=lambda r: (r["o"], r["_id"])):
        turn[r["y"]].append(r)
    taken, texts, used = [], set(), 0
    for r in (r for pair in itertools.zip_longest(*turn.values()) for r in pair if r is not None):
        if r["h"] not in texts and used + r["n"] <= most_bytes:
            used += r["n"]
            texts.add(r["h"])
            taken.append((r["_id"], r["h"]))
    if not taken:
        return [], []
    wanted = spark.createDataFrame(taken, "_id long, _h long")
    found = rows.withColumn("_h", F.xxhash64("_text")).join(F.broadcast(wanted), ["_id", "_h"]).groupBy("_id").agg(F.max("_y").alias("y"), F.min("_text").alias("t")).orderBy("_id").collect()
    return [r["t"] for r in found], [r["y"] for r in found]
