"""What the operators of this subpackage share: column naming, text access and the white-space rule.

A word is a run of characters other than blank, tab, line feed, vertical tab, form feed and carriage return.  ``bytes.split()`` cuts at
exactly these six bytes, so texts travel to Python as UTF-8 and are never decoded just to be split.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that the frame doesn't hold yet (Spark compares names without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def prefix(df: DataFrame, name: str) -> str:
    """A prefix that no column of the frame begins with."""
    name += "_"
    while any(c.lower().startswith(name) for c in df.columns):
        name += "_"
    return name


def n_words(text: Column) -> Column:
    """Number of words; null counts as an empty text."""
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != ""))


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def id_fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


FILTER_BITS = 1 << 22  # 512 KB, whatever the number of ids; 32,768 bits are one row of ``bitmap_construct_agg``


def _bit(ids: Column) -> Column:
    return F.pmod(F.xxhash64(ids), F.lit(FILTER_BITS))


def id_filter(ids: DataFrame) -> Callable[[Column], Column]:
    """A test that is true for every id of the one column of ``ids``, and seldom for others as long as they are few against ``FILTER_BITS``.

    The bits are set by a partial aggregation and only they are collected: a table of fixed size.  Rows that fail the test need no join with ``ids``.
    """
    at = _bit(F.col(ids.columns[0])) + 1
    sets = ids.select(F.call_function("bitmap_bucket_number", at).alias("bucket"), F.call_function("bitmap_bit_position", at).alias("at"))
    bits = np.zeros(FILTER_BITS, dtype=bool)
    for r in sets.groupBy("bucket").agg(F.call_function("bitmap_construct_agg", F.col("at")).alias("bits")).collect():
        held = np.unpackbits(np.frombuffer(r["bits"], dtype=np.uint8), bitorder="little")
        bits[(r["bucket"] - 1) * len(held) : r["bucket"] * len(held)] = held
    packed = np.packbits(bits)

    def held_in(at: pd.Series) -> pd.Series:
        a = at.to_numpy()
        return pd.Series((packed[a >> 3] >> (7 - (a & 7)).astype(np.uint8) & 1).astype(bool))

    held_in.__annotations__ = {"at": pd.Series, "return": pd.Series}
    test = F.pandas_udf(held_in, "boolean")
    return lambda column: test(_bit(column))


def text_udf(one: Callable[[bytes | None], object], returns: str) -> Callable[[Column], Column]:
    """Column function for ``one`` over whole texts as UTF-8.

    A plain UDF: Spark hands over a hundred rows at a time, where an Arrow batch holds 10,000 texts at once, in the executor's JVM and in Python.  Marked as
    nondeterministic, so that a filter on the result doesn't make Spark compute it a second time.
    """
    udf = F.udf(one, returns, useArrow=False).asNondeterministic()
    return lambda text: udf(text.cast("binary"))


def arrow_map(df: DataFrame, make: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """``mapInArrow`` with a function of one batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = make(batch)
            if out is not None:
                yield out

    return df.mapInArrow(run, schema)
