"""Concept-archive ingest as a stream: insert-if-absent, exactly once.

The archive is a table in buckets of its key (``sources.buckets``).  A batch reads only the buckets that its rows fall into and adds its new rows to them, so
its cost does not depend on the number of batches before it.  Batch i makes version i + 1 from version i; replayed, it makes the same again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corpuskit.sources.buckets import BucketedTable

BATCH = "batch"


def open_archive(spark: SparkSession, path: str, schema: str, key: str, base: DataFrame, buckets: int = 64) -> BucketedTable:
    """The archive at ``path``, made from ``base`` (what was stored before; columns it lacks are null) where there is none."""
    archive = BucketedTable(spark, path, f"{schema}, {BATCH} bigint", [key], buckets)
    if archive.latest() is None:
        archive.create(base.dropDuplicates([key]))
    return archive


def add_batch(batch: DataFrame, batch_id: int, archive: BucketedTable, order: list[str]) -> None:
    """Store the rows of one batch whose key is new."""
    archive.insert(batch.withColumn(BATCH, F.lit(batch_id).cast("bigint")), order, batch_id + 1, batch_id)


def read_added(archive: BucketedTable) -> DataFrame:
    """Rows that the stream added."""
    return archive.read().where(F.col(BATCH).isNotNull()).drop(BATCH)


def start_ingest(rows: DataFrame, archive: BucketedTable, order: list[str], checkpoint: str) -> StreamingQuery:
    """Stream ``rows`` (columns of the archive) into the archive."""
    return (
        rows.writeStream.foreachBatch(lambda df, i: add_batch(df, i, archive, order))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
