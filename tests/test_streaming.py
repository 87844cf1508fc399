"""Streams: equal to batch, exactly once, late data counted."""

from pyspark.sql import functions as F

from corpuskit.operators.usage import daily_ledger
from corpuskit.streaming import ingest, ledger

CALLS = "ts timestamp, model string, input_tokens bigint, output_tokens bigint, total_tokens bigint"


def _calls(spark, days):
    rows = spark.createDataFrame([(d, i) for d in days for i in range(5)], "d int, i int")
    ts = F.timestamp_seconds(F.lit(1704067200) + F.col("d") * 86400 + F.col("i") * 60)
    return rows.select(
        ts.alias("ts"), F.concat(F.lit("m"), F.col("i") % 2).alias("model"), F.lit(1).cast("bigint").alias("input_tokens"),
        F.lit(2).cast("bigint").alias("output_tokens"), F.lit(3).cast("bigint").alias("total_tokens"),
    )


def _cells(df):
    return sorted((str(r["day"]), r["model"], r["total_tokens"], r["calls"]) for r in df.collect())


def test_ledger_over_unordered_files_equals_batch(spark, tmp_path):
    source, state, check = (str(tmp_path / n) for n in ("calls", "state", "check"))
    for days in ([30, 31], [1, 30], [0, 2]):  # later files hold earlier days
        _calls(spark, days).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(CALLS).option("maxFilesPerTrigger", 1).parquet(source)
    ledger.start_ledger(stream, ["model"], state, check).awaitTermination()
    batch = daily_ledger(spark.read.parquet(source), "ts", ["model"])
    assert _cells(ledger.read_ledger(spark, state, ["model"])) == _cells(batch)
    # more calls later: the stream resumes from its checkpoint
    _calls(spark, [30]).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(CALLS).option("maxFilesPerTrigger", 1).parquet(source)
    ledger.start_ledger(stream, ["model"], state, check).awaitTermination()
    assert _cells(ledger.read_ledger(spark, state, ["model"])) == _cells(daily_ledger(spark.read.parquet(source), "ts", ["model"]))


def test_late_calls_are_kept_apart(spark, tmp_path):
    source, state, check = (str(tmp_path / n) for n in ("calls", "state", "check"))
    _calls(spark, [10, 11]).coalesce(1).write.parquet(f"{source}/part0")
    for days in ([11, 0], [3]):
        stream = spark.readStream.schema(CALLS).parquet(f"{source}/*")
        ledger.start_late_ledger(stream, ["model"], state, check, "1 hour").awaitTermination()
        _calls(spark, days).coalesce(1).write.parquet(f"{source}/part{days[0]}")
    stream = spark.readStream.schema(CALLS).parquet(f"{source}/*")
    ledger.start_late_ledger(stream, ["model"], state, check, "1 hour").awaitTermination()
    kept, late = ledger.read_late_ledger(spark, state, ["model"]), ledger.read_late_calls(spark, state)
    assert sum(r["calls"] for r in kept.collect()) == 15 and late.count() == 10
    in_time = _calls(spark, [10, 11]).union(_calls(spark, [11]))
    assert _cells(kept) == _cells(daily_ledger(in_time, "ts", ["model"]))


def test_late_ledger_falls_back_to_both_token_counts(spark, tmp_path):
    source, state, check = (str(tmp_path / n) for n in ("calls", "state", "check"))
    calls = _calls(spark, [1]).withColumn("total_tokens", F.lit(None).cast("bigint"))
    calls.coalesce(1).write.parquet(source)
    stream = spark.readStream.schema(CALLS).parquet(source)
    ledger.start_late_ledger(stream, ["model"], state, check, "1 hour").awaitTermination()
    assert _cells(ledger.read_late_ledger(spark, state, ["model"])) == _cells(daily_ledger(calls, "ts", ["model"]))


def test_ingest_replay_changes_nothing(spark, tmp_path):
    schema = "name string, pos int"
    archive = ingest.open_archive(spark, str(tmp_path / "state"), schema, "name", spark.createDataFrame([("a",)], "name string"), buckets=4)
    first = spark.createDataFrame([("a", 1), ("b", 2), ("b", 1)], schema)
    second = spark.createDataFrame([("b", 0), ("c", 3)], schema)
    for _ in range(2):
        ingest.add_batch(first, 0, archive, ["pos"])
    for _ in range(2):
        ingest.add_batch(second, 1, archive, ["pos"])
    # an old batch replayed after a newer one
    ingest.add_batch(first, 0, archive, ["pos"])
    assert sorted(tuple(r) for r in ingest.read_added(archive).collect()) == [("b", 1), ("c", 3)]
    assert sorted(r["name"] for r in archive.read().collect()) == ["a", "b", "c"]


def test_ingest_of_many_batches_equals_batch(spark, tmp_path):
    """Fifty files, one per batch; a batch reads a bounded number of files however many batches came before."""
    source, schema = str(tmp_path / "rows"), "name string, pos int"
    rows = [(f"n{(i * 7) % 60}", i) for i in range(150)]
    for i in range(0, 150, 3):
        spark.createDataFrame(rows[i : i + 3], schema).coalesce(1).write.mode("append").parquet(source)
    archive = ingest.open_archive(spark, str(tmp_path / "state"), schema, "name", spark.createDataFrame([("n1",)], "name string"), buckets=2)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    ingest.start_ingest(stream, archive, ["pos"], str(tmp_path / "check")).awaitTermination()
    assert archive.latest() == 50
    assert max(len(v) for v in archive.manifest(50).values()) < archive.deltas
    first = {}
    for name, pos in rows:
        first.setdefault(name, pos)
    first.pop("n1")
    assert {r["name"]: r["pos"] for r in ingest.read_added(archive).collect()} == first


def test_window_ledger_drops_state_and_counts_late_calls(spark, tmp_path):
    source, check = str(tmp_path / "calls"), str(tmp_path / "check")
    for i, days in enumerate(([0, 1], [10], [11], [12, 0])):  # day 0 comes back two batches after day 10, whose watermark has passed it
        _calls(spark, days).coalesce(1).write.parquet(f"{source}/part{i}")
    days = ledger.window_table(spark, str(tmp_path / "days"), ["model"], buckets=2)
    stream = spark.readStream.schema(CALLS).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(f"{source}/*")
    query = ledger.start_window_ledger(stream, ["model"], days, check, "2 days")
    query.awaitTermination()
    kept = _calls(spark, [0, 1, 10, 11, 12])
    assert _cells(days.read()) == _cells(daily_ledger(kept, "ts", ["model"]))
    assert ledger.late_calls(query, days) == 5
    assert ledger.state_rows(query) <= 6  # three days of two models; days 0 and 1 are gone


def test_window_ledger_replays_a_batch(spark, tmp_path):
    days = ledger.window_table(spark, str(tmp_path / "days"), ["model"], buckets=2)
    schema = "day string, model string, input_tokens long, output_tokens long, total_tokens long, calls long"
    one = spark.createDataFrame([("2024-01-01", "a", 1, 1, 2, 1), ("2024-01-01", None, 1, 1, 2, 1)], schema).withColumn("day", F.col("day").cast("date"))
    two = spark.createDataFrame([("2024-01-01", None, 5, 5, 10, 2)], schema).withColumn("day", F.col("day").cast("date"))
    for changed, i in ((one, 0), (two, 1), (one, 0), (two, 1)):
        days.upsert(changed, i + 1, i)
    assert _cells_any(days.read()) == [("None", 10, 2), ("a", 2, 1)]


def _cells_any(df):
    return sorted((str(r["model"]), r["total_tokens"], r["calls"]) for r in df.collect())
