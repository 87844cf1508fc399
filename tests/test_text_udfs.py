"""Whole texts go to plain UDFs, a hundred rows at a time; their results are those of the Arrow UDFs."""

from pyspark.sql import functions as F

from corpuskit.functions import python_udfs as U
from corpuskit.functions import text as X

TEXTS = [None, "", "the PCR of the ﬁrst Straße &amp; &lt;the&gt; 漢字 😀 İK", "IL-6 the " * 300, f"a text with its own {U.OPEN} marks the"]


def test_same_results_as_over_arrow(spark):
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "i int, t string")
    for text, arrow in ((U.nfkc_text, U.nfkc), (U.casefold_text, U.casefold), (U.unescape_text, U.unescape_html)):
        assert all(r["a"] == r["b"] for r in rows.select(text("t").alias("a"), arrow("t").alias("b")).collect())
    listed = F.when(F.col("i") != 3, F.array(F.lit("the"), F.lit("PCR")))
    for a, b in ((U.protect_terms_text(["the"])("t"), U.protect_terms_udf(["the"])("t")), (U.protect_listed_text("t", listed), U.protect_listed("t", F.coalesce(listed, F.array().cast("array<string>"))))):
        protected = rows.select("t", a.alias("a"), b.alias("b"))
        assert all(r["a"] == r["b"] for r in protected.collect())
        back = protected.select("t", U.restore_text("a.text", "a.terms").alias("p"), U.restore_terms("b.text", "b.terms").alias("q"))
        assert [(r["p"], r["q"]) for r in back.collect()] == [(t or "", t or "") for t in TEXTS]
    none = rows.select(U.restore_text("t", F.lit(None).cast("array<struct<token: string, original: string>>")).alias("t"))
    assert [r["t"] for r in none.collect()] == TEXTS


def test_no_arrow_batches_of_whole_texts(spark, capsys):
    from corpuskit.plans.catalog import QUERIES

    docs = spark.createDataFrame([(1, "a text")], "doc_id long, text string")
    frames = [docs.select(X.title_digest("text"), X.clean_text("text"))]
    frames += [QUERIES[name](spark, "/root/testdata/sf0.001") for name in ("content_hash", "protect_docs", "protect_roundtrip", "clean_pages", "norm_title")]
    for df in frames:
        df.explain()
        plan = capsys.readouterr().out
        assert "BatchEvalPython" in plan and "Arrow" not in plan
