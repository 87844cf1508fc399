"""Whole texts reach Python a hundred rows at a time, and the sample of labelled texts is held once."""

import tracemalloc

import numpy as np
from pyspark.sql import functions as F

from corpuskit.llm import quality_rules, simhash_dedup, toxicity
from corpuskit.llm.common import text_udf


def test_texts_arrive_as_their_bytes(spark):
    every = [bytes(range(256)), b"", None, "Ünï 漢字 😀".encode(), b"\xff\xfe x" * 5000]
    rows = spark.createDataFrame(list(enumerate(every)), "i int, raw binary")
    same = text_udf(lambda raw: raw, "binary")
    size = text_udf(lambda raw: -1 if raw is None else len(raw), "int")
    out = rows.select("i", same(F.col("raw")).alias("same"), size(F.col("raw")).alias("n")).orderBy("i").collect()
    assert [None if r["same"] is None else bytes(r["same"]) for r in out] == every
    assert [r["n"] for r in out] == [-1 if b is None else len(b) for b in every]


def test_no_arrow_batches_of_whole_texts(spark, documents, marks, capsys):
    judge = toxicity.scorer(spark.createDataFrame([(-1, 0.5), (3, 1.0)], toxicity.SCHEMA))
    for df in (documents.select(judge(F.col("text"))), documents.select(quality_rules.measures(F.col("text"))), simhash_dedup.set_prints(documents)):
        df.explain()
        plan = capsys.readouterr().out
        assert "BatchEvalPython" in plan and "Arrow" not in plan


def test_prints_are_signed(spark, documents):
    for r in simhash_dedup.set_prints(documents.select("doc_id", "text")).distinct().join(documents.select("doc_id", "text").distinct(), "doc_id").collect():
        h = simhash_dedup.shingles(None if r["text"] is None else r["text"].encode())
        assert r["n"] == len(h) and np.int64(r["key"]).view(np.uint64) == simhash_dedup.set_key(h)


def test_training_does_not_copy_its_rows():
    row = np.arange(2000, dtype=np.int32)
    rows, labels = [row] * 1000, np.arange(1000) % 2
    tracemalloc.start()
    try:
        toxicity.ftrl(rows, labels, 4096, 2.0, 1.0, 3.0, 0.1, 1)
        assert tracemalloc.get_traced_memory()[1] < 2e6  # the rows with their intercepts alone are 16 MB
    finally:
        tracemalloc.stop()


def test_texts_without_words_train_too(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([None, "", "a bad word", "fine words"] * 10)], "doc_id long, text string")
    marks = docs.select("doc_id", (F.col("text") == "a bad word").cast("int").alias("toxic")).fillna(0, ["toxic"])
    weights = toxicity.fit(docs, marks).collect()
    assert weights[0]["feature"] == -1
