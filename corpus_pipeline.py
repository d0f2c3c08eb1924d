"""Corpus pipeline: toxicity, line deduplication, near duplicates, benchmark decontamination, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all
but the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from microveil.llm import decontaminate, jaccard_join, line_dedup, packing
from microveil.llm import toxicity as crf
from microveil.llm.shared import cut, shared_folder, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the chain model rejects."""
    return crf.tag(docs.select(*COLUMNS), table(spark, sf_dir, "labels"), spans=False).where("predicted = 0").select(*COLUMNS)


def line_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops repeated lines; a document that loses all its lines, and so holds nothing new, goes. n_chars is counted anew."""
    out = line_dedup.dedup(docs.select(*COLUMNS))
    kept = out.where("n_dropped = 0 OR trim(text) <> ''")
    return kept.select("doc_id", "text", "lang", "source", F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of each group of near duplicates (five-word shingles, similarity 0.8 or more)."""
    groups = jaccard_join.link(docs, k=5, percent=80)
    gone = cut(groups.where("component_id <> doc_id").select("doc_id"))
    # texts without a document that goes in their slot need no shuffle (SLOTS rows at most are broadcast)
    slot = F.pmod(F.xxhash64("doc_id"), F.lit(jaccard_join.SLOTS))
    slots = F.broadcast(gone.select(slot.alias("slot")).distinct())
    sure = docs.join(slots, slot == F.col("slot"), "left_anti")
    rest = docs.join(slots, slot == F.col("slot"), "left_semi").join(gone, "doc_id", "left_anti")
    return sure.select(*COLUMNS).unionByName(rest.select(*COLUMNS))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold benchmark passages."""
    return decontaminate.contaminated(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark")).where("NOT contaminated").select(*COLUMNS)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places the token pieces of what is left in sequences of 1024 tokens."""
    return packing.pack(packing.pieces(docs), ["doc_id", "piece"], group_rows=16384)


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_deduplication),
    ("ngram_jaccard_join", near_duplicates),
    ("decontamination", decontamination),
    ("best_fit_packing", best_fit_packing),
]

#: The model, edit distances and components aren't SQL; the stages are tested against brute force.
ORACLE_SQL = None


def _removed(spark: SparkSession, folder: str) -> None:
    """Deletes a folder of the shared file system."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over ``documents``, each written as Parquet in the shared folder and read again.

    A stage's rows are deleted once the next one is written; those that the result is read from stay.
    """
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    before = None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            _removed(spark, f"{folder}/{before}")
        before = name
    return STAGES[-1][1](spark, docs, sf_dir)
