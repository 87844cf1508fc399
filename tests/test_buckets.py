"""Bucketed tables: only touched buckets are written; upserts and inserts agree with the plain operators."""

import os

from pyspark.sql import functions as F

from corpuskit.operators import keyed
from corpuskit.sources.buckets import BucketedTable

SCHEMA = "k int, v string, n bigint"


def _files(path):
    return {os.path.join(d, f): os.path.getmtime(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def _rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_one_row_change_leaves_other_buckets_alone(spark, tmp_path):
    path = str(tmp_path / "t")
    table = BucketedTable(spark, path, SCHEMA, ["k"], buckets=8)
    table.create(spark.range(200).select(F.col("id").cast("int").alias("k"), F.lit("old").alias("v"), F.col("id").alias("n")))
    before = _files(path)
    table.upsert(spark.createDataFrame([(17, "new")], "k int, v string"), 1, 0)
    after = _files(path)
    assert all(after[f] == t for f, t in before.items())
    assert len([f for f in after if f not in before and "/data/" in f]) == 1
    changed = {b: v for b, v in table.manifest(1).items() if v != [0]}
    assert len(changed) == 1 and list(changed.values()) == [[1]]
    assert _rows(table.read().where("k = 17")) == [(17, "new", 17)]
    assert table.read().count() == 200 and table.read(0).where("v = 'new'").count() == 0


def test_upsert_agrees_with_the_plain_operator(spark, tmp_path):
    table = BucketedTable(spark, str(tmp_path / "t"), SCHEMA, ["k"], buckets=3)
    base = spark.createDataFrame([(1, "a", 1), (2, None, None), (None, "null key", 3)], SCHEMA)
    table.create(base)
    updates = spark.createDataFrame([(2, "b"), (5, "c"), (None, "changed")], "k int, v string")
    table.upsert(updates, 1, 0, {"n": F.lit(-1).cast("bigint")})
    assert _rows(table.read()) == sorted([(1, "a", 1), (2, "b", None), (5, "c", -1), (None, "changed", 3)], key=repr)
    plain = keyed.upsert(base.where("k IS NOT NULL"), updates.where("k IS NOT NULL"), ["k"], {"n": F.lit(-1).cast("bigint")})
    assert _rows(table.read().where("k IS NOT NULL")) == _rows(plain)
    table.upsert(updates.where("k > 9"), 2, 1)  # nothing to do
    assert table.latest() == 2 and _rows(table.read(2)) == _rows(table.read(1))


def test_inserts_are_compacted(spark, tmp_path):
    table = BucketedTable(spark, str(tmp_path / "t"), SCHEMA, ["k"], buckets=2, deltas=3)
    table.create(spark.createDataFrame([], SCHEMA))
    assert table.read().count() == 0
    want = {}
    for i in range(9):
        rows = [(j % 12, f"from {i}", i) for j in range(i, i + 4)]
        for k, v, n in rows:
            want.setdefault(k, (k, v, n))
        table.insert(spark.createDataFrame(rows, SCHEMA), ["n"], i + 1, i)
        assert all(len(v) < 3 for v in table.manifest(i + 1).values())
    assert _rows(table.read()) == sorted(want.values(), key=repr)
