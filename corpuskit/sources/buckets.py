"""A keyed table in buckets of its key hash, written in numbered versions.

Rows lie in ``data/version=<v>/bucket=<b>``; ``manifest/version=<v>`` lists, for each bucket, the versions whose files make it up.  A commit reads and writes only
the buckets that its rows fall into and then writes its manifest, so its cost depends on what it touches, not on the number of commits before.  An upsert
rewrites the buckets it touches; an insert adds a file of new rows to them, and once a bucket consists of ``deltas`` files it is written anew as one.

Files of a version never change but by a repeated commit of the same version on the same predecessor, which writes the same rows again: commits that
are numbered by their batch are idempotent.  Readers name a version; a commit that failed half-way has no manifest and is not seen.

Everything goes through Spark's readers and writers, so the table may lie in any store.  Null keys are keys like others.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuskit.operators import keyed
from corpuskit.session import staged

_KEY, _BUCKET = "__key", "__bucket"


class BucketedTable:
    def __init__(self, spark: SparkSession, path: str, schema: str, keys: Sequence[str], buckets: int = 64, deltas: int = 8) -> None:
        self.spark, self.path, self.schema, self.keys = spark, path.rstrip("/"), schema, list(keys)
        self.buckets, self.deltas = buckets, deltas
        self.columns = spark.createDataFrame([], schema).columns

    def _keyed(self, rows: DataFrame) -> DataFrame:
        """With one key column that is never null, and the bucket."""
        key = F.to_json(F.struct(*self.keys))
        return rows.withColumn(_KEY, key).withColumn(_BUCKET, F.pmod(F.xxhash64(_KEY), F.lit(self.buckets)).cast("int"))

    def latest(self) -> int | None:
        """The largest version with a manifest."""
        jvm = self.spark._jvm
        folder = jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifest")
        store = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not store.exists(folder):
            return None
        names = [str(s.getPath().getName()) for s in store.listStatus(folder)]
        return max((int(n.removeprefix("version=")) for n in names if n.startswith("version=")), default=None)

    def manifest(self, version: int) -> dict[int, list[int]]:
        """The versions that make up each bucket: at most ``buckets`` times ``deltas`` rows."""
        rows = self.spark.read.schema("bucket int, version bigint").parquet(f"{self.path}/manifest/version={version}").collect()
        held: dict[int, list[int]] = {}
        for r in sorted(rows, key=lambda r: r["version"]):
            held.setdefault(r["bucket"], []).append(r["version"])
        return held

    def read(self, version: int | None = None, only: Sequence[int] | None = None) -> DataFrame:
        """The table as of a version (the latest by default), or some of its buckets."""
        version = self.latest() if version is None else version
        held = {} if version is None else self.manifest(version)
        paths = [f"{self.path}/data/version={v}/bucket={b}" for b, vs in sorted(held.items()) if only is None or b in only for v in vs]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def _commit(self, rows: DataFrame, version: int, held: dict[int, list[int]], whole: Sequence[int] | None) -> None:
        """Write ``rows`` as files of this version and the manifest: buckets in ``whole`` (all if None) consist of them alone, others gain them."""
        folder = f"{self.path}/data/version={version}"
        dealt = self._keyed(rows.select(*self.columns)).drop(_KEY).withColumnRenamed(_BUCKET, "bucket")
        dealt.repartition("bucket").write.partitionBy("bucket").mode("overwrite").parquet(folder)
        written = self.spark.read.schema(f"{self.schema}, bucket int").parquet(folder).select("bucket").distinct().collect()
        held = dict(held)
        for b in (r["bucket"] for r in written):
            held[b] = [version] if whole is None or b in whole else [*held.get(b, []), version]
        lines = [(b, v) for b, vs in held.items() for v in vs]
        self.spark.createDataFrame(lines, "bucket int, version bigint").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/version={version}")

    def create(self, rows: DataFrame, version: int = 0) -> None:
        """The first version; ``rows`` is unique on the keys, columns it lacks are null."""
        cells = [(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in self.spark.createDataFrame([], self.schema).schema]
        self._commit(rows.select(*cells), version, {}, None)

    def _touched(self, rows: DataFrame) -> list[int]:
        return [r[_BUCKET] for r in rows.select(_BUCKET).distinct().collect()]

    def upsert(
        self, updates: DataFrame, version: int, previous: int, defaults: Mapping[str, Column] | None = None, touch: Mapping[str, Column] | None = None
    ) -> None:
        """``keyed.upsert`` on the buckets of ``updates`` (unique on the keys), as ``version`` after ``previous``."""
        new = staged(self._keyed(updates), "updates")
        touched = self._touched(new)
        old = self._keyed(self.read(previous, touched)).drop(_BUCKET)
        state = keyed.upsert(old, new.drop(_BUCKET), [_KEY], defaults, touch)
        self._commit(state, version, self.manifest(previous), touched)

    def insert(self, candidates: DataFrame, order: Sequence[str], version: int, previous: int) -> None:
        """Add the first candidate of every key that the table lacks; stored rows stay as they are."""
        new = staged(self._keyed(keyed.dedupe_first(candidates, self.keys, order)), "candidates")
        touched, held = self._touched(new), self.manifest(previous)
        known = self._keyed(self.read(previous, touched)).select(_KEY)
        added = new.join(known, _KEY, "left_anti").select(*self.columns)
        full = [b for b in touched if len(held.get(b, [])) + 1 >= self.deltas]
        self._commit(added.unionByName(self.read(previous, full)), version, held, full)
