"""On each side of former limits: sample bounds, blocks of languages, wide counters, small and large edge tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from linemend.llm import decontaminate, graph, jaccard, language, packing, toxicity

FOLDER = "/root/testdata/sf0.001"


def _roots(edges):
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {x: root(x) for x in parent}


@pytest.mark.parametrize("finish", [1 << 19, 0])
def test_components_in_one_task_and_in_rounds(spark, monkeypatch, finish):
    monkeypatch.setattr(graph, "FINISH", finish)
    rng = np.random.default_rng(3)
    edges = [(i + 1, i) for i in range(60)] + [(100, int(x)) for x in range(200, 240)] + rng.integers(-500, -1, (150, 2)).tolist()
    edges = [(int(a), int(b)) for a, b in edges if a != b]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == _roots(edges)


def test_no_edges(spark):
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_fingerprint_of_very_long_windows(spark):
    """32,767 words fit counters of 16 bits, 32,768 don't; and 150,000 of one word."""
    for n, kinds in ((32_767, 50), (32_768, 50), (150_000, 1)):
        words = spark.range(1).select(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.xxhash64(i % kinds)).alias("h"))
        row = words.select("h", decontaminate.simhash(F.col("h")).alias("print")).first()
        bits = np.unpackbits(np.array(row.h, np.int64).view(np.uint8).reshape(n, 8), axis=1, bitorder="little").sum(axis=0)
        expected = np.packbits(bits * 2 > n, bitorder="little").view(np.int64)[0]
        assert row["print"] == expected


def test_languages_in_blocks(spark, monkeypatch):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    train = docs.withColumn("lang", F.concat("lang", F.lit("-"), (F.col("doc_id") % 5).cast("string")))
    model = language.fit(train)
    assert len(model[0]) > 4
    keys = {"doc_id": F.col("doc_id")}
    whole = {r.doc_id: (r.lang_pred, r.score) for r in language.predict(docs, model, "text", keys).collect()}
    monkeypatch.setattr(language, "BLOCK", 3)
    for r in language.predict(docs, model, "text", keys).collect():
        assert r.lang_pred == whole[r.doc_id][0] and abs(r.score - whole[r.doc_id][1]) < 1e-9


def test_letters_of_every_plane(spark):
    rows = [(1, "\U00020000\U00020001\U0002a6d0", "x"), (2, "plain words", "y"), (3, "\U000323af", None), (4, "\U0001f600 12", None), (5, "\U000e0041", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r.lang_pred for r in language.predict(docs, language.fit(docs), "text", {"doc_id": F.col("doc_id")}).collect()}
    assert got[1] == "x" and got[3] in ("x", "y") and got[4] == got[5] == "und"


def test_sample_keeps_its_bound(spark):
    rows = [(i % 5, f"text {i}", "z") for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _id string")
    labels = spark.createDataFrame([(i % 7, i % 2) for i in range(70)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    assert toxicity.training_sample(docs, labels, "doc_id", "text", "toxic", 2).count() <= 2
    assert toxicity.training_sample(docs, labels, "doc_id", "text", "toxic", 100).count() == 5


CLASHES = ["_id", "_hash", "_leak_id", "_leak_hash", "_ID", "__id", "_label", "_text", "id", "text_hash", "label", "root", "class", "chunk", "carry", "shard"]


def test_stages_with_clashing_columns(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(60)
    bench = spark.read.parquet(f"{FOLDER}/benchmark.parquet")
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    spark.conf.set("spark.sql.caseSensitive", "true")
    try:
        named = docs.select("*", *(F.lit(i).alias(c) for i, c in enumerate(CLASHES)))
        for kept in (
            jaccard.keep_one(named, shingle=5, threshold=0.8),
            decontaminate.clean(named, bench),
            toxicity.keep_clean(named, toxicity.fit(named, labels)),
            corpus_pipeline.dedup_lines(spark, named, FOLDER),
        ):
            assert kept.columns == named.columns and 0 < kept.count() <= 60
    finally:
        spark.conf.unset("spark.sql.caseSensitive")
    assert packing.END_ID == 2
