"""Two-level ordered operators against plain windows, with one hot key."""

import random

from pyspark.sql import functions as F

from corpuskit.operators import ordered


def _rows(n=600):
    rng = random.Random(1)
    return [("hot" if rng.random() < 0.5 else f"k{rng.randrange(5)}", i, rng.randrange(9), rng.choice(["a", "b", None])) for i in range(n)]


def test_prefix_sum(spark):
    rows = _rows()
    df = spark.createDataFrame(rows, "k string, i long, v long, w string")
    got = {r["i"]: r["s"] for r in ordered.prefix_sum(df, ["k"], ["i"], F.floor(F.col("i") / 37), F.col("v"), "s").collect()}
    sums, want = {}, {}
    for k, i, v, _ in rows:
        sums[k] = want[i] = sums.get(k, 0) + v
    assert got == want


def test_last_known(spark):
    rows = _rows()
    df = spark.createDataFrame(rows, "k string, i long, v long, w string")
    got = {r["i"]: r["last"] for r in ordered.last_known(df, ["k"], ["i"], F.floor(F.col("i") / 41), F.col("w"), "last").collect()}
    last, want = {}, {}
    for k, i, _, w in rows:
        last[k] = w if w is not None else last.get(k)
        want[i] = last[k]
    assert got == want


def test_first_bundle_is_what_fits_the_budget(spark):
    df = spark.createDataFrame([("a", 0, "xxxx"), ("a", 1, "yyyy"), ("a", 2, "zzzz"), ("b", 0, "q" * 20)], "k string, i int, t string")
    rows = ordered.bundle_by_length(df, ["k"], ["i"], F.col("i"), "t", 8).collect()
    assert {(r["k"], r["i"]): r["t"] for r in rows if r["bundle"] == 0} == {("a", 0): "xxxx", ("a", 1): "yyy", ("b", 0): "q" * 8}
    assert {(r["k"], r["i"], r["bundle"]): r["t"] for r in rows if r["bundle"]} == {("a", 1, 1): "y", ("a", 2, 1): "zzzz", ("b", 0, 1): "q" * 8, ("b", 0, 2): "q" * 4}


def test_pair_in_order_is_guarded(spark):
    left = spark.createDataFrame([("a", 3), ("a", 1), ("b", 1)], "d string, n int")
    right = spark.createDataFrame([("a", 20), ("a", 10), ("b", 5), ("b", 6)], "d string, p int")
    paired = ordered.pair_in_order(left, right, ["d"], (["n"], F.lit(0)), (["p"], F.lit(0)))
    assert sorted((r["d"], r["n"], r["p"]) for r in paired.collect()) == [("a", 1, 10), ("a", 3, 20)]


def test_top_k_limits_before_the_shuffle(spark):
    df = spark.createDataFrame(_rows(), "k string, i long, v long, w string")
    plan = ordered.top_k(df, ["k"], [F.desc("v"), F.asc("i")], 3)._jdf.queryExecution().optimizedPlan().toString()
    assert "WindowGroupLimit" in plan
