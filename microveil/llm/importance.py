"""Target-distribution importance resampling over hashed word runs, by external sort and count.

Features are all runs of 1 to ``n`` consecutive words; a feature's bucket is the crc32 of its
UTF-8 bytes modulo ``buckets``. The corpus is tokenised once: every batch of documents becomes
packed streams of uint16 buckets with the offsets of their documents, written in the shared
folder. Counts come from the streams, sorted and run-length encoded one by one and
summed by bucket; the gain of a bucket is the scaled log ratio of its smoothed shares in the
target and in the corpus. Streams are then read again, the gains of their buckets gathered, and
added up between offsets (``np.add.reduceat``). A document's weight plus Gumbel noise
from a hash of its id is its score, so the highest scores are a draw without
replacement with probabilities in proportion to exp(weight / 1000).

Ranks over all drawn documents are made of ranks inside ranges of the score and the number of
rows in the ranges before. The driver sees a table of ``buckets`` gains and one count a partition.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from microveil.llm.shared import cut, small_batches

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")  # over UTF-8: every byte of a letter that isn't ASCII is in a word
STREAMS = "ids array<long>, words array<long>, parts array<long>, offsets array<long>, stream binary"
KINDS = [pa.list_(pa.int64())] * 4 + [pa.binary()]
SLICE = 1 << 18  # bytes that are tokenised at once


def words_of(text: str) -> Iterator[list[bytes]]:
    """The words of a whole text with A-Z in lower case, those of a bounded stretch at a time; no word is cut."""
    data = text.encode("utf-8", "surrogatepass").lower()  # of bytes, only A-Z change
    at = 0
    while at < len(data):
        end = at + SLICE
        over = WORD.match(data, end)  # a word that goes on over the end of the stretch
        end = over.end() if over else end
        yield WORD.findall(data, at, end)
        at = end


def run_buckets(before: list[bytes], words: list[bytes], n: int, buckets: int) -> np.ndarray:
    """Buckets of all runs of up to ``n`` words that end in ``words``; ``before`` has the words just before them, and is brought forward.

    The checksum of a run continues that of the run which is shorter by its last word.
    """
    crc, lead, chain = zlib.crc32, len(before), before + words
    spaced = [b" " + w for w in chain]
    sums = list(map(crc, chain))
    out = [np.array(sums[lead:], np.uint32)]
    for k in range(1, n):  # sums[i] becomes that of chain[i : i + k + 1]
        sums = list(map(crc, spaced[k:], sums))
        out.append(np.array(sums[max(0, lead - k) :], np.uint32))
    before[:] = chain[max(0, len(chain) - n + 1) :]
    return (np.concatenate(out) % buckets).astype("<u2")


class Packed:
    """Documents of the stream that is being filled."""

    def __init__(self):
        self.ids, self.words, self.parts, self.offsets, self.held, self.size = [], [], [], [0], [], 0

    def add(self, buckets: np.ndarray) -> None:
        self.held.append(buckets)
        self.size += len(buckets)

    def end(self, doc_id: int | None, words: int, part: int | None) -> None:
        for to, x in ((self.ids, doc_id), (self.words, words), (self.parts, part), (self.offsets, self.size)):
            to.append(x)

    def row(self) -> pa.RecordBatch:
        stream = np.concatenate(self.held).tobytes() if self.held else b""
        values = zip([self.ids, self.words, self.parts, self.offsets, stream], KINDS, strict=True)
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in values], names=[f.split()[0] for f in STREAMS.split(", ")])


def _streams(batches, n: int, buckets: int, most: int) -> Iterator[pa.RecordBatch]:
    """Packed streams of about ``most`` buckets at most; a document that would go over that goes on in the next stream."""
    first = TaskContext.get().partitionId() << 33
    now, number = Packed(), 0
    for b in batches:
        for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            number += 1
            before, seen, part = [], 0, None
            for words in words_of(text.as_py() or ""):
                if now.size >= most:
                    part = first + number
                    now.end(doc_id, seen, part)
                    yield now.row()
                    now, seen = Packed(), 0
                now.add(run_buckets(before, words, n, buckets))
                seen += len(words)
            now.end(doc_id, seen, part)
            if now.size >= most // 2 or len(now.ids) >= 100_000:
                yield now.row()
                now = Packed()
    if now.ids:
        yield now.row()


def streams(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 3, buckets: int = 10_000, most: int = 1 << 20) -> DataFrame:
    """Packed bucket streams: one row holds many documents (``ids``, ``words``), whose buckets lie between ``offsets`` of ``stream``.

    ``parts`` has a number of the document where it is over several rows, else null. A null text has no words.
    """
    if not 1 <= buckets <= 1 << 16:
        raise ValueError("buckets are packed in 16 bits")
    small_batches(docs.sparkSession)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(partial(_streams, n=n, buckets=buckets, most=most), STREAMS)


def _run_lengths(batches) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for packed in b.column(0):
            x = np.sort(np.frombuffer(packed.as_buffer(), "<u2"))
            if not len(x):
                continue
            head = np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1])))
            lengths = np.diff(np.append(head, len(x)))
            yield pa.RecordBatch.from_arrays([pa.array(x[head].astype(np.int32)), pa.array(lengths.astype(np.int64))], names=["bucket", "n"])


def counts(packed: DataFrame) -> dict[int, int]:
    """How often each bucket occurs in the streams; at most 65,536 numbers come to the driver."""
    runs = packed.select("stream").mapInArrow(_run_lengths, "bucket int, n long")
    return {r["bucket"]: r["n"] for r in runs.groupBy("bucket").agg(F.sum("n").alias("n")).collect()}


def gains(corpus: dict[int, int], target: dict[int, int], buckets: int = 10_000) -> np.ndarray:
    """floor(1000 ln((t + 1)(S + buckets) / ((s + 1)(T + buckets)))) of every bucket."""
    all_s, all_t = float(sum(corpus.values()) + buckets), float(sum(target.values()) + buckets)
    ratio = lambda s, t: ((t + 1.0) * all_s) / ((s + 1.0) * all_t)
    return np.array([math.floor(1000 * math.log(ratio(corpus.get(b, 0), target.get(b, 0)))) for b in range(buckets)], np.int64)


def _weighed(batches, gain: np.ndarray) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i in range(b.num_rows):
            row = {n: b.column(k)[i] for k, n in enumerate(b.schema.names)}
            offsets = row["offsets"].values.to_numpy()
            sizes = np.diff(offsets)
            got = gain[np.frombuffer(row["stream"].as_buffer(), "<u2")]
            weight = np.zeros(len(sizes), np.int64)
            some = sizes > 0  # reduceat gives an empty stretch the value at its start
            if some.any():
                weight[some] = np.add.reduceat(got, offsets[:-1][some])
            yield pa.RecordBatch.from_arrays([row["ids"].values, row["words"].values, row["parts"].values, pa.array(sizes), pa.array(weight)], names=["doc_id", "n_words", "part", "n_features", "weight"])


def noise(seed: int, doc_id: int | None) -> int:
    """Gumbel noise in thousandths from the first 32 bits of sha256 of ``seed:doc_id``."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def _scored(batches, seed: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        score = b.column("weight").to_numpy() + np.array([noise(seed, i) for i in b.column("doc_id").to_pylist()], np.int64)
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(score.astype(np.int64))], names=[*b.schema.names, "score"])


def weights(packed: DataFrame, gain: np.ndarray, seed: int = 42) -> DataFrame:
    """doc_id, n_words, n_features, weight and score of every document of the streams."""
    parts = packed.mapInArrow(partial(_weighed, gain=gain), "doc_id long, n_words long, part long, n_features long, weight long")
    columns = ["n_words", "n_features", "weight"]
    # documents over several streams are put together again; whole ones need no shuffle
    long = parts.where("part IS NOT NULL").groupBy("part").agg(F.min("doc_id").alias("doc_id"), *[F.sum(c).alias(c) for c in columns])
    whole = parts.where("part IS NULL").select("doc_id", *columns).unionByName(long.drop("part"))
    return whole.mapInArrow(partial(_scored, seed=seed), "doc_id long, n_words long, n_features long, weight long, score long")


def ranked(df: DataFrame, order: list) -> DataFrame:
    """Adds ``rank``, the row's place (from 1) in ``order`` over the whole table, which no task sees whole.

    Rows are dealt by ranges of the order and sorted there; the rows of the ranges before are
    counted. The driver gets one count a partition. The sorted table is checkpointed.
    """
    placed = cut(df.repartitionByRange(*order).sortWithinPartitions(*order)).withColumn("_at", F.monotonically_increasing_id())
    here = F.shiftright("_at", 33)
    sizes = placed.groupBy(here.cast("int").alias("_p")).agg(F.count(F.lit(1)).alias("_n")).collect()
    before, starts = 0, []
    for r in sorted(sizes, key=lambda r: r["_p"]):
        starts.append((r["_p"], before))
        before += r["_n"]
    if not starts:
        return df.withColumn("rank", F.lit(None).cast("long"))
    starts = F.broadcast(df.sparkSession.createDataFrame(starts, "_p int, _before long"))  # a row a partition
    rank = F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1) + 1
    return placed.withColumn("_p", here.cast("int")).join(starts, "_p").withColumn("rank", rank).drop("_p", "_at", "_before")


def resample(
    docs: DataFrame,
    target: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_text_col: str = "text",
    percent: float = 5,
    least_words: int = 20,
    n: int = 3,
    buckets: int = 10_000,
    seed: int = 42,
) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every document; rank is null where a document isn't drawn.

    floor(percent * N / 100) of the N documents with ``least_words`` words or more are drawn,
    highest scores first, ties to the smaller id. Null and empty texts have weight 0 and are never
    drawn (unless ``least_words`` is 0). Rows that repeat an id each count, and share its noise; a null
    id has that of an empty one. With an empty target all its counts are 0; an empty corpus gives an empty result.
    Columns of ``docs`` other than the two are left aside.
    """
    packed = cut(streams(docs, id_col, text_col, n, buckets))
    wanted = streams(target.select(F.lit(0).alias("doc_id"), F.col(target_text_col).alias("text")), n=n, buckets=buckets)
    scored = cut(weights(packed, gains(counts(packed), counts(wanted), buckets), seed))
    able = F.col("n_words") >= least_words
    drawn = math.floor(percent * scored.where(able).count() / 100)
    first = ranked(scored.where(able), [F.desc("score"), F.col("doc_id").asc_nulls_last()])
    every = first.unionByName(scored.where(~able).withColumn("rank", F.lit(None).cast("long")))
    return every.select("doc_id", "n_features", "weight", "score", F.when(F.col("rank") <= drawn, F.col("rank")).alias("rank"))
