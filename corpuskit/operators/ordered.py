"""Ordered operators that survive a hot key: running sums, last-known values, positional pairing, top-k.

A plain window over a key puts the whole key into one task.  Here every key is cut into buckets of its order; buckets are
aggregated first, the small per-bucket table carries totals along the key, and rows are finished inside their bucket.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_BUCKET = "__bucket"


def _running(keys: Sequence[str], order: Sequence[str | Column]):
    return Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def _same(left: str, right: str, names: Sequence[str]) -> Column:
    cond = F.lit(True)
    for name in names:
        cond = cond & F.col(f"{left}.{name}").eqNullSafe(F.col(f"{right}.{name}"))
    return cond


def _attach(df: DataFrame, small: DataFrame, on: Sequence[str], columns: Sequence[str]) -> DataFrame:
    joined = df.alias("l").join(small.alias("r"), _same("l", "r", on), "left")
    return joined.select("l.*", *[f"r.{c}" for c in columns])


def prefix_sum(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: Column, value: Column, out: str
) -> DataFrame:
    """Running sum of ``value`` in ``order`` within ``keys``.  ``bucket`` must not decrease along the order."""
    rows = df.withColumn(_BUCKET, bucket).withColumn("__v", value)
    totals = rows.groupBy(*keys, _BUCKET).agg(F.sum("__v").alias("__total"))
    before = Window.partitionBy(*keys).orderBy(_BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.withColumn("__offset", F.coalesce(F.sum("__total").over(before), F.lit(0)))
    rows = rows.withColumn("__in_bucket", F.sum("__v").over(_running([*keys, _BUCKET], order)))
    joined = _attach(rows, offsets, [*keys, _BUCKET], ["__offset"])
    return joined.withColumn(out, F.col("__in_bucket") + F.col("__offset")).drop(
        _BUCKET, "__v", "__in_bucket", "__offset"
    )


def number_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: Column, out: str) -> DataFrame:
    """1-based row number within ``keys``."""
    return prefix_sum(df, keys, order, bucket, F.lit(1).cast("bigint"), out)


def last_known(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: Column, value: Column, out: str
) -> DataFrame:
    """Last non-null ``value`` at or before each row: the as-of join of two event kinds held in one frame."""
    rows = df.withColumn(_BUCKET, bucket).withColumn("__v", value)
    lasts = rows.where(F.col("__v").isNotNull()).groupBy(*keys, _BUCKET).agg(
        F.max_by("__v", F.struct(*order)).alias("__last")
    )
    buckets = rows.select(*keys, _BUCKET).distinct()
    before = Window.partitionBy(*keys).orderBy(_BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    carried = _attach(buckets, lasts, [*keys, _BUCKET], ["__last"]).withColumn(
        "__carried", F.last("__last", ignorenulls=True).over(before)
    )
    rows = rows.withColumn("__in_bucket", F.last("__v", ignorenulls=True).over(_running([*keys, _BUCKET], order)))
    joined = _attach(rows, carried, [*keys, _BUCKET], ["__carried"])
    return joined.withColumn(out, F.coalesce("__in_bucket", "__carried")).drop(
        _BUCKET, "__v", "__in_bucket", "__carried"
    )


def bundle_by_length(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: Column, text: str, budget: int, out: str = "bundle"
) -> DataFrame:
    """Cut the texts of a key, in order, into bundles of ``budget`` characters, numbered from 0 in ``out``.

    Every text costs its length plus one (the separator).  A text that crosses a bundle's end is cut there and goes on in the next bundle, so that nothing
    is lost; the first bundle is what fits into one budget.
    """
    size = F.length(F.coalesce(text, F.lit(""))).cast("bigint")
    rows = prefix_sum(df, keys, order, bucket, size + 1, "__used")
    start, end = F.col("__used") - size - 1, F.col("__used") - 1
    first, last = F.floor(start / budget), F.floor(F.greatest(end - 1, start) / budget)
    cut = rows.withColumns({"__start": start, "__end": end}).withColumn(out, F.explode(F.sequence(first, last)))
    low = F.greatest(F.col(out) * budget - F.col("__start"), F.lit(0))
    high = F.least((F.col(out) + 1) * budget, F.col("__end")) - F.col("__start")
    return cut.withColumn(text, F.substring(F.col(text), (low + 1).cast("int"), F.greatest(high - low, F.lit(0)).cast("int"))).drop("__start", "__end", "__used")


def pair_in_order(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_order: tuple[Sequence[str], Column],
    right_order: tuple[Sequence[str], Column],
) -> DataFrame:
    """Pair the n-th left row with the n-th right row of a key, only where both sides have the same number of rows.

    Each order is (columns, bucket expression).  The columns of both sides other than the keys must differ in name.  Both sides run through the plan as one frame: rows
    are numbered in their bucket, the small bucket table carries the rows before a bucket and the totals of both sides along the key, and a pair
    meets in one aggregation by key and number.  Null keys take no part.
    """
    rest = {side: [c for c in df.columns if c not in keys] for side, df in enumerate((left, right))}

    def tagged(df: DataFrame, side: int, bucket: Column) -> DataFrame:
        known = df.where(" AND ".join(f"`{k}` IS NOT NULL" for k in keys))
        return known.select("*", F.lit(side).alias("__side"), bucket.cast("bigint").alias(_BUCKET))

    rows = tagged(left, 0, left_order[1]).unionByName(tagged(right, 1, right_order[1]), allowMissingColumns=True)
    totals = rows.groupBy(*keys, "__side", _BUCKET).agg(F.count("*").alias("__n"))
    whole = Window.partitionBy(*keys)
    before = whole.orderBy("__side", _BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    n_left, n_right = (F.sum(F.when(F.col("__side") == side, F.col("__n")).otherwise(0)).over(whole) for side in (0, 1))
    carried = totals.withColumns({"__before": F.coalesce(F.sum("__n").over(before), F.lit(0)), "__nl": n_left, "__nr": n_right}).where("__nl = __nr")
    # the left side comes first along the key, so the right one starts after all of it
    offsets = carried.select(*keys, "__side", _BUCKET, (F.col("__before") - F.when(F.col("__side") == 1, F.col("__nl")).otherwise(0)).alias("__before"))
    in_bucket = Window.partitionBy(*keys, "__side", _BUCKET).orderBy(*left_order[0], *right_order[0])
    numbered = rows.withColumn("__in_bucket", F.row_number().over(in_bucket)).join(offsets, [*keys, "__side", _BUCKET])
    placed = numbered.withColumn("pair_no", F.col("__before") + F.col("__in_bucket"))
    sides = [F.first(F.when(F.col("__side") == side, F.struct(*rest[side])), ignorenulls=True).alias(f"__{side}") for side in (0, 1)]
    paired = placed.groupBy(*keys, "pair_no").agg(*sides)
    return paired.select(*keys, "pair_no", *[F.col(f"__{side}.{c}").alias(c) for side in (0, 1) for c in rest[side]])


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str | None = None) -> DataFrame:
    """First ``k`` rows per key.  Spark limits each map task to ``k`` rows per key before the shuffle."""
    rn = rank or "__rn"
    out = df.withColumn(rn, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(rn) <= k)
    return out if rank else out.drop(rn)


def best_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The one best row per key."""
    return top_k(df, keys, order, 1)
