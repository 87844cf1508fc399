"""Keyed tables: lookup, upsert, insert-if-absent, promotion, hit counters and planning of missing work.

Plain files have no MERGE, so the writing operators return the new table state; ``sources.tables.write_state`` stores it.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def point_read(table: DataFrame, key: str, value, columns: Sequence[str]) -> DataFrame:
    """One row by key; filter and column list reach the scan."""
    return table.where(F.col(key) == F.lit(value)).select(*columns).limit(1)


def project(table: DataFrame, columns: Mapping[str, str | Column]) -> DataFrame:
    """Select and rename: new name -> column."""
    return table.select(*[(F.col(c) if isinstance(c, str) else c).alias(name) for name, c in columns.items()])


def row_count(table: DataFrame) -> DataFrame:
    return table.agg(F.count("*").alias("n_rows"))


def dedupe_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First row per key.  Partial aggregation keeps hot keys small before the shuffle."""
    return _pick(df, keys, order, F.min_by)


def dedupe_last(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    return _pick(df, keys, order, F.max_by)


def _pick(df: DataFrame, keys: Sequence[str], order: Sequence[str], by) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(by(F.struct(*rest), F.struct(*order)).alias("__row"))
    return picked.select(*keys, "__row.*").select(*df.columns)


def upsert(
    target: DataFrame,
    updates: DataFrame,
    keys: Sequence[str],
    defaults: Mapping[str, Column] | None = None,
    touch: Mapping[str, Column] | None = None,
) -> DataFrame:
    """New state of ``target``: rows of ``updates`` replace the columns they carry, other columns keep the old value.

    ``updates`` must be unique on the keys (``dedupe_last``).  New rows get ``defaults`` for columns not in the update;
    ``touch`` columns (a caller-given time stamp) are set on every written row.
    """
    defaults, touch = defaults or {}, touch or {}
    payload = [c for c in updates.columns if c not in keys]
    t = target.select(*keys, *[F.col(c).alias(f"__t_{c}") for c in target.columns if c not in keys], F.lit(True).alias("__old"))
    u = updates.select(*keys, *[F.col(c).alias(f"__u_{c}") for c in payload], F.lit(True).alias("__new"))
    joined = t.join(u, list(keys), "full_outer")
    written, kept = F.col("__new").isNotNull(), F.col("__old").isNotNull()

    def cell(field) -> Column:
        name = field.name
        if name in keys:
            return F.col(name)
        old = F.col(f"__t_{name}")
        if name in touch:
            out = F.when(written, touch[name]).otherwise(old)
        elif name in payload:
            out = F.when(written, F.col(f"__u_{name}")).otherwise(old)
        else:
            out = F.when(kept, old).otherwise(defaults.get(name, F.lit(None)))
        return out.cast(field.dataType).alias(name)

    return joined.select(*[cell(f) for f in target.schema.fields])


def append_new(target: DataFrame, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Add rows with unknown keys (``rows`` is unique on them); columns they lack become null."""
    new = rows.join(target.select(*keys), list(keys), "left_anti")
    cells = [
        (F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in target.schema.fields
    ]
    return target.unionByName(new.select(*cells))


def insert_if_absent(target: DataFrame, candidates: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Add unknown keys only (first candidate wins); rows already stored are never overwritten."""
    return append_new(target, dedupe_first(candidates, keys, order), keys)


def stage_lookup(requests: DataFrame, cache: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Cached rows of the requested composite keys."""
    return requests.join(cache, list(keys), "inner")


def plan_missing(
    entities: DataFrame, key: str, stages: Sequence[str], cache: DataFrame, version: str | None = None
) -> DataFrame:
    """(entity, stage) pairs without a cached row of the current version: the work still to do.

    The stage list is a literal of the caller, so the pairs come from an explode, not from a join.
    """
    wanted = entities.select(key, F.explode(F.array(*[F.lit(s) for s in stages])).alias("stage"))
    have = cache if version is None else cache.where(F.col("analysis_version") == version)
    return wanted.join(have.select(key, "stage"), [key, "stage"], "left_anti")


def file_to_entity(requests: DataFrame, aliases: DataFrame, entities: DataFrame) -> DataFrame:
    """File hash -> alias -> attributes of the canonical entity."""
    return requests.join(aliases, "file_hash").join(entities, "canonical_key")


def promote_legacy(
    legacy: DataFrame,
    aliases: DataFrame,
    current: DataFrame,
    defaults: Mapping[str, Column],
    keep: str = "newest",
) -> DataFrame:
    """Move results keyed by file hash under their canonical key.

    ``keep='newest'`` leaves a stored row alone unless the legacy row is younger; ``keep='legacy'`` always replaces it,
    hit count included.
    """
    keys = ["canonical_key", "depth", "stage", "analysis_version"]
    moved = legacy.join(aliases.select("file_hash", "canonical_key"), "file_hash").drop("file_hash")
    for name, value in defaults.items():
        moved = moved.withColumn(name, F.coalesce(F.col(name), value) if name in moved.columns else value)
    moved = dedupe_last(moved, keys, ["updated_at", "model"])
    if keep == "newest":
        newer = current.select(*keys, F.col("updated_at").alias("__at"))
        moved = moved.join(newer, keys, "left").where("__at IS NULL OR updated_at > __at").drop("__at")
    return upsert(current, moved, keys)


def count_hits(hits: DataFrame, key: str, request: str | None = None) -> DataFrame:
    """Hits per key; with ``request`` a key counts once per request."""
    rows = hits.select(key, request).distinct() if request else hits
    return rows.groupBy(key).agg(F.count("*").alias("new_hits"))


def add_hits(table: DataFrame, hits: DataFrame, key: str, counter: str = "hit_count") -> DataFrame:
    """Counter column increased by the aggregated hits."""
    joined = table.join(hits, key, "left")
    return joined.withColumn(counter, F.col(counter) + F.coalesce("new_hits", F.lit(0))).select(*table.columns)
