"""Daily usage ledger as a stream.

Two designs.  ``start_window_ledger`` holds event-time windows behind a watermark and upserts the days that change into a bucketed table: state stays as long as the
delay, calls behind the watermark are dropped and counted.  ``start_ledger`` and ``start_late_ledger`` never lose a call.

In ``start_ledger`` state is one row per (day, key): it grows with days and models, not with calls, so no watermark is set and no late
call is ever dropped.  Each micro-batch writes its changed rows to its own folder; a replayed batch overwrites the same folder, and
the reader keeps the latest version of each row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corpuskit.operators.keyed import dedupe_last
from corpuskit.operators.usage import daily_ledger
from corpuskit.sources.buckets import BucketedTable
from corpuskit.sources.tables import read_or_empty

SUMS = ("input_tokens", "output_tokens", "total_tokens")


def start_ledger(calls: DataFrame, keys: Sequence[str], state_path: str, checkpoint: str, ts: str = "ts") -> StreamingQuery:
    """Update-mode ledger over a stream of calls (``ts, input_tokens, output_tokens, total_tokens`` and the keys)."""

    def store(changed: DataFrame, batch_id: int) -> None:
        changed.withColumn("version", F.lit(batch_id)).write.mode("overwrite").parquet(f"{state_path}/batch={batch_id}")

    return (
        daily_ledger(calls, ts, keys)
        .writeStream.outputMode("update")
        .foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def start_late_ledger(
    calls: DataFrame, keys: Sequence[str], state_path: str, checkpoint: str, delay: str, ts: str = "ts"
) -> StreamingQuery:
    """Ledger that keeps calls apart which come more than ``delay`` behind the latest call of earlier batches.

    Every batch writes three folders of its own, which a replay overwrites: the ledger of its calls in time, its late calls as they
    are, and the latest time it saw.  No streaming state is held, and each call is in exactly one of the first two.
    """

    def store(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        seen = read_or_empty(spark, f"{state_path}/seen", "latest timestamp, batch bigint").where(F.col("batch") < batch_id)
        latest = seen.agg(F.max("latest")).first()[0]
        late = F.lit(False)
        if latest is not None:
            late = F.coalesce(F.col(ts) < F.lit(latest) - F.expr(f"INTERVAL {delay}"), F.lit(False))
        daily_ledger(batch.where(~late), ts, keys).write.mode("overwrite").parquet(f"{state_path}/ledger/batch={batch_id}")
        batch.where(late).write.mode("overwrite").parquet(f"{state_path}/late/batch={batch_id}")
        batch.agg(F.max(ts).alias("latest")).write.mode("overwrite").parquet(f"{state_path}/seen/batch={batch_id}")

    return calls.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_late_ledger(spark: SparkSession, state_path: str, keys: Sequence[str]) -> DataFrame:
    """The ledger of all batches of ``start_late_ledger``."""
    sums = ("input_tokens", "output_tokens", "total_tokens", "calls")
    return spark.read.parquet(f"{state_path}/ledger").groupBy("day", *keys).agg(*[F.sum(c).alias(c) for c in sums])


def read_late_calls(spark: SparkSession, state_path: str) -> DataFrame:
    """The late calls themselves, with the batch that brought them."""
    return spark.read.parquet(f"{state_path}/late")


def read_ledger(spark: SparkSession, state_path: str, keys: Sequence[str]) -> DataFrame:
    """Latest version of each ledger row."""
    versions = spark.read.parquet(state_path).drop("batch")
    return dedupe_last(versions, ["day", *keys], ["version"]).drop("version")


def window_table(spark: SparkSession, path: str, keys: Sequence[str], buckets: int = 16) -> BucketedTable:
    """An empty ledger table for ``start_window_ledger``; keys are strings."""
    columns = ["day date", *[f"{k} string" for k in keys], *[f"{c} bigint" for c in (*SUMS, "calls")]]
    table = BucketedTable(spark, path, ", ".join(columns), ["day", *keys], buckets)
    if table.latest() is None:
        table.create(spark.createDataFrame([], table.schema))
    return table


def start_window_ledger(calls: DataFrame, keys: Sequence[str], table: BucketedTable, checkpoint: str, delay: str, ts: str = "ts") -> StreamingQuery:
    """Tumbling days in event time, update mode, upserted by batch id.

    A day's row in the state is dropped once the watermark (the latest call less ``delay``) has passed its end; calls that come later are left out, see
    ``late_calls``.  Batch i makes version i + 1 of the table from version i, so a replayed batch writes what it wrote before.
    """
    tokens = F.coalesce("total_tokens", F.col("input_tokens") + F.col("output_tokens"))
    days = calls.withWatermark(ts, delay).groupBy(F.window(ts, "1 day").alias("w"), *keys)
    sums = days.agg(*[F.sum(tokens if c == "total_tokens" else F.col(c)).alias(c) for c in SUMS], F.count("*").alias("calls"))
    rows = sums.select(F.to_date("w.start").alias("day"), *keys, *SUMS, "calls")
    return (
        rows.writeStream.outputMode("update")
        .foreachBatch(lambda changed, i: table.upsert(changed, i + 1, i))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def late_calls(query: StreamingQuery, table: BucketedTable, before: int = 0) -> int:
    """Calls that a finished ``start_window_ledger`` read but left out as too late; ``before`` is the number of calls in the table when it started."""
    read = sum(p["numInputRows"] for p in query.recentProgress)
    held = table.read().agg(F.coalesce(F.sum("calls"), F.lit(0)).alias("n")).first()["n"]
    return read + before - held


def state_rows(query: StreamingQuery) -> int:
    """Rows in the state store after the last batch."""
    return sum(o["numRowsTotal"] for o in query.lastProgress["stateOperators"])
