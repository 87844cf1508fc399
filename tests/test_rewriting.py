"""The rewriting job: what goes, what comes back, what stays."""

from pyspark.sql import functions as F

from corpuskit.functions.python_udfs import restore_terms
from corpuskit.operators import search
from corpuskit.plans import rewriting


def _run(spark, texts, terms, rewrite, max_chars=40):
    df = spark.createDataFrame(texts, "id int, lang string, text string")
    plan = rewriting.plan_rewriting(df, spark.createDataFrame([(t,) for t in terms], "term string"), wanted=F.col("lang") == "en", max_chars=max_chars)
    asked = {r["chunk_id"]: r["chunk"] for r in rewriting.chunk_requests(plan).collect()}
    answers = [(i, a) for i, c in asked.items() if (a := rewrite(c)) is not False]
    back = rewriting.apply_answers(plan, spark.createDataFrame(answers, "chunk_id string, answer string"))
    return {r["id"]: (r["rewritten"], r["n_chunks"], r["n_kept"]) for r in back.collect()}, asked


def test_terms_survive_and_bad_answers_fall_back(spark):
    texts = [
        (1, "en", "We used PCR and western Blots here. Then we slept. Nothing else happened on that day."),
        (2, "en", ""), (3, "en", None), (4, "fr", "On dort."), (5, None, "no language"),
        (6, "en", "We used PCR and western Blots here. Bad gateway ahead."),
        (7, "en", "이 문장은 한국어로 쓰여 있다 PCR"),
    ]

    def rewrite(chunk):
        if "slept" in chunk:
            return "<html>Error 500</html>"
        return False if "happened" in chunk else chunk.upper()

    got, asked = _run(spark, texts, ["western blot", "unused term", "x"], rewrite)
    assert got[1] == ("WE USED PCR AND western BlotS HERE. Then we slept. Nothing else happened on that day.", 3, 2)
    assert got[6][0] == "WE USED PCR AND western BlotS HERE. Bad gateway ahead." and got[6][2] == 1  # an answer that looks like an error page
    assert [got[i] for i in (2, 3, 4, 5, 7)] == [("", 0, 0), (None, 0, 0), ("On dort.", 0, 0), ("no language", 0, 0), ("이 문장은 한국어로 쓰여 있다 PCR", 0, 0)]
    assert len(asked) == 4  # the first sentence is asked for once


def test_a_cut_inside_a_placeholder_is_healed(spark):
    got, _ = _run(spark, [(1, "en", "ABC" + " ABC" * 30)], [], str, max_chars=5)
    assert got[1][0].replace(" ", "") == "ABC" * 31
    row = spark.createDataFrame([("  ", [{"token": "t", "original": str(i)} for i in range(11)])], "text string, terms array<struct<token: string, original: string>>")
    assert row.select(restore_terms("text", "terms").alias("v")).first()["v"] == "10"


def test_empty_tables(spark):
    got, asked = _run(spark, [], [], str)
    assert got == {} and asked == {}


def test_ranked_search_over_a_table_of_queries(spark):
    methods = spark.createDataFrame(
        [("Flow Cytometry", ["FACS", "flow-cyto"], "cell", "cytometry"), ("Mass Cytometry", ["CyTOF"], "cell", "cytometry"), ("flow", None, None, None), ("PCR", [], "dna", None), (None, ["x"], "", "")],
        "name string, aliases array<string>, category string, parent_method string",
    )
    asked = ["flow", "FLOW", "flow_cyto", "cyt", "cytometry", "cell", "c", "facs", "dna", " ", None, "nothing", "mass cytometry", "flow", "-cyto"]
    queries = spark.createDataFrame([(q,) for q in asked], "query string")
    for k in (1, 2, 20):
        got = {(r["query"], r["name"], r["tier"], r["rank"]) for r in search.rank_matches_table(methods, queries, k).collect()}
        want = search.rank_matches(methods.where("name IS NOT NULL"), sorted({q for q in asked if q}), k).collect()
        assert got == {(r["query"], r["name"], r["tier"], r["rank"]) for r in want}
