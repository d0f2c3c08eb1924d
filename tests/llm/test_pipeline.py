"""The pipeline's stages take effect, keep clean documents, and agree with brute force at the end."""

from __future__ import annotations

import random

import corpus_pipeline
import pytest

WORDS = [f"t{i}" for i in range(500)]


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(2)
    text = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    passage, leak, near = text(60), text(30), text(100).split()
    docs, labels = [], []
    for i in range(200):
        w = text(80)
        if i % 3 == 0:
            w = w.replace(" ", " vilefool ", 3)
        docs.append((i, w, "en", "s", len(w)))
        labels.append((i, 1, int(i % 3 == 0)))
    special = {1001: text(50) + "\n" + passage, 1002: text(50) + "\n" + passage, 1003: " ".join(near), 1004: " ".join(["x", *near[1:]]), 1005: text(20) + " " + leak + " " + text(20), 1006: "a text that comes twice, word for word", 1007: "a text that comes twice, word for word", 1008: "", 1009: None}
    docs += [(i, t, "en", "s", len(t or "")) for i, t in special.items()]
    folder = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def test_stages(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, corpus).collect(), docs.schema)
        assert docs.columns == corpus_pipeline.COLUMNS
        seen[name] = {r["doc_id"]: r["text"] for r in docs.collect()}
    clean = {i for i in range(200) if i % 3}
    assert set(seen["toxicity"]) == clean | set(range(1001, 1010))
    lines = seen["line_dedup"]
    assert 1007 not in lines and lines[1002] == before[1002].split("\n")[0] and lines[1001] == before[1001] and {1008, 1009} <= set(lines)
    links = seen["ngram_jaccard_join"]
    assert 1003 in links and 1004 not in links
    left = seen["decontamination"]
    assert 1005 not in left and clean <= set(left)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, corpus).toPandas()
    assert set(packed.doc_id) == set(left) and packed.groupby("sequence_id").length.sum().max() <= 1024
    whole = corpus_pipeline.run(spark, corpus).toPandas()
    assert sorted(zip(whole.doc_id, whole.ids_crc32, strict=True)) == sorted(zip(packed.doc_id, packed.ids_crc32, strict=True))


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_on_awkward_rows(spark, corpus, name):
    """Empty tables; null, repeated and huge rows: no stage fails, and each keeps what has nothing wrong."""
    stage = dict(corpus_pipeline.STAGES)[name]
    schema = spark.read.parquet(f"{corpus}/documents.parquet").schema
    assert stage(spark, spark.createDataFrame([], schema), corpus).count() == 0
    huge = " ".join(f"t{i * 7919 % 100_003}" for i in range(60_000))
    rows = [(1, "one text of its own with several words in it", "en", "s", 5), (2, None, None, None, None), (3, "", "en", "s", 0), (None, "a text without an id has words as well", "en", "s", 9), (4, huge, "en", "s", len(huge)), (5, "said twice, row for row, and more of it", "en", "s", 7), (5, "said twice, row for row, and more of it", "en", "s", 7)]
    out = stage(spark, spark.createDataFrame(rows, schema), corpus)
    got = [(r["doc_id"], None) for r in out.collect()] if name == "best_fit_packing" else [(r["doc_id"], r["text"]) for r in out.collect()]
    ids = [i for i, _ in got]
    assert {1, 2, 3, 4, 5} <= set(ids)
    if name != "best_fit_packing":
        assert out.columns == corpus_pipeline.COLUMNS and (4, huge) in got and (2, None) in got and (3, "") in got
    if name in ("toxicity", "decontamination", "line_dedup"):
        assert None in ids and ids.count(5) == 2
    if name == "ngram_jaccard_join":
        assert None in ids  # what has no id links with nothing and stays


def test_run_leaves_no_earlier_stage_behind(spark, corpus):
    import os

    from microveil.llm.shared import shared_folder

    folder = shared_folder(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    corpus_pipeline.run(spark, corpus).count()
    new = [x for x in os.listdir(folder) if x not in before and x.startswith("pipeline-")]
    assert len(new) == 1 and os.listdir(f"{folder}/{new[0]}") == [corpus_pipeline.STAGES[-2][0]]
