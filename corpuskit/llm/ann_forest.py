"""Approximate nearest neighbours by a forest of hash prefixes.

Each of ``TREES`` trees gives a vector a string of ``BITS`` bits (sides of random hyperplanes).  A tree is its strings in sorted order; all vectors that share a
prefix with a query are one range of it.  A query descends in every tree to its longest prefix, then ascends in all trees at once, one bit after the other,
until the ranges together hold enough candidates, and these are compared exactly.  Inner products are searched as angles: vectors get one
more component that brings them to equal length, queries a zero.

How many candidates are enough is measured, not guessed: for a sample of queries the true neighbours are found by a scan, and the deepest level whose ranges hold
``TARGET`` of them sets the number.  For vectors without structure that is a large share of all vectors, whatever the index.

Sorted arrays are kept in segments: the vectors of a tree below one prefix that lies above the level searched, in chunks of at most ``CHUNK`` where a segment
is larger; a query visits all chunks of its segment.  Equal vectors are one entry with its least ids, so a frequent vector is searched once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuskit.llm.common import arrow_map
from corpuskit.session import staged

TREES = 20
BITS = 32
CHUNK = 16_384
QUERY_BLOCK = 2048
SAMPLE = 64
TARGET = 0.92


class Forest:
    """Random hyperplanes for vectors of ``dim`` components, lengthened to ``longest``."""

    def __init__(self, dim: int, longest: float, trees: int = TREES, bits: int = BITS, seed: int = 11) -> None:
        self.longest, self.trees, self.bits = longest, trees, bits
        self.planes = np.random.default_rng(seed).standard_normal((dim + 1, trees * bits))

    def strings(self, x: np.ndarray, queries: bool) -> np.ndarray:
        """Bit strings as integers, one row per vector and one column per tree."""
        extra = np.zeros(len(x)) if queries else np.sqrt(np.maximum(0.0, self.longest**2 - (x * x).sum(axis=1)))
        sides = (np.column_stack([x, extra]) @ self.planes > 0).reshape(len(x), self.trees, self.bits)
        return sides @ (1 << np.arange(self.bits - 1, -1, -1, dtype=np.int64))


def common_prefix(a: np.ndarray, b: np.ndarray, bits: int) -> np.ndarray:
    """Length of the longest common prefix of bit strings."""
    differ = (a ^ b).astype(np.float64)
    return np.where(differ == 0, bits, bits - np.frexp(differ)[1])


def _matrix(column, dtype: str, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=dtype).reshape(-1, dim).astype(np.float64)


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k largest scores, ties by id, all positions if fewer."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = np.flatnonzero(scores >= least)
    else:
        near = np.arange(len(scores))
    return near[np.lexsort((ids[near], -scores[near]))][:k]


def usable(vectors: DataFrame, vec: str = "embedding", vec_id: str = "vec_id") -> tuple[DataFrame, int, str]:
    """((vec_id, vec as bytes), dimension, number type): rows that take part.

    Null ids and vectors that are null, zero or hold null or non-finite components take no part, nor do those that are not of the most
    frequent length.  Of rows with the same id, the least vector counts.
    """
    inf = float("inf")
    fine = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < inf)) & F.exists(vec, lambda x: x != 0)
    rows = vectors.select(F.col(vec_id).cast("bigint").alias("vec_id"), F.col(vec).alias("vec")).where(F.col("vec_id").isNotNull() & F.coalesce(fine, F.lit(False)))
    sizes = rows.groupBy(F.size("vec").alias("size")).count().orderBy(F.desc("count"), "size").first()
    dim = sizes["size"] if sizes else 1
    kind = "<f4" if dict(rows.dtypes)["vec"] == "array<float>" else "<f8"
    numbers = rows.where(F.size("vec") == dim).select("vec_id", F.col("vec").cast("array<float>" if kind == "<f4" else "array<double>"))

    def pack(batch: pa.RecordBatch) -> pa.RecordBatch:
        flat = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(-1, dim) + 0.0
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([v.tobytes() for v in flat], pa.binary())], names=["vec_id", "vec"])

    return arrow_map(numbers, pack, "vec_id bigint, vec binary").groupBy("vec_id").agg(F.min("vec").alias("vec")), dim, kind


def _calibrate(classes: DataFrame, forest: Forest, dim: int, kind: str, k: int, sample: int, target: float) -> tuple[int, int]:
    """(level, candidates): the deepest level at which the sample's true neighbours are found, and how many candidates it takes."""
    asked = classes.where("asked").orderBy(F.xxhash64("cid"), "cid").limit(sample).collect()
    if not asked:
        return 0, 0
    probes = np.frombuffer(b"".join(r["vec"] for r in asked), dtype=kind).reshape(-1, dim).astype(np.float64)
    own = np.array([r["cid"] for r in asked])
    strings = forest.strings(probes, queries=True)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((len(probes), forest.bits + 1), dtype=np.int64)
        kept: list[tuple[int, float, int, int]] = []
        for b in batches:
            x, cid = _matrix(b.column(1), kind, dim), b.column(0).to_numpy()
            scores, hashed = probes @ x.T, forest.strings(x, queries=False)
            for q in range(len(probes)):
                shared = common_prefix(hashed, strings[q], forest.bits)
                counts[q] += np.bincount(shared.ravel().astype(np.int64), minlength=forest.bits + 1)
                best = _best(scores[q], cid, k + 1)
                kept += [(q, float(scores[q, i]), int(cid[i]), int(shared[i].max())) for i in best if cid[i] != own[q]]
        rows = [(q, -1.0, int(n), level) for q in range(len(probes)) for level, n in enumerate(counts[q].tolist()) if n]
        names = ("q", "score", "cid", "level")
        yield pa.RecordBatch.from_pylist([dict(zip((*names, "kind"), (*r, 0), strict=True)) for r in kept] + [dict(zip((*names, "kind"), (*r, 1), strict=True)) for r in rows], schema=pa.schema([("q", pa.int32()), ("score", pa.float64()), ("cid", pa.int64()), ("level", pa.int32()), ("kind", pa.int32())]))

    found = classes.select("cid", "vec").mapInArrow(scan, "q int, score double, cid bigint, level int, kind int")
    found = staged(found, "forest-sample")
    near = found.where("kind = 0").withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "cid"))).where(F.col("r") <= k)
    levels = {r["level"]: r["count"] for r in near.groupBy("level").count().collect()}
    sizes = {r["level"]: r["n"] for r in found.where("kind = 1").groupBy("level").agg(F.sum("cid").alias("n")).collect()}
    total = sum(levels.values())
    for level in range(forest.bits, 0, -1):
        if total and sum(n for at, n in levels.items() if at >= level) >= target * total:
            return level, sum(n for at, n in sizes.items() if at >= level) // len(probes)
    return 0, 0


def _dealt(classes: DataFrame, asked: DataFrame, forest: Forest, dim: int, kind: str, level: int) -> tuple[DataFrame, DataFrame]:
    """Entries and queries by tree, segment, chunk and query block: every query meets every chunk of its segment in every tree."""

    def hashed(df: DataFrame, queries: bool, extra: str) -> DataFrame:
        def make(batch: pa.RecordBatch) -> pa.RecordBatch:
            strings = forest.strings(_matrix(batch.column(1), kind, dim), queries)
            again = np.repeat(np.arange(batch.num_rows), forest.trees)
            columns = [c.take(pa.array(again)) for c in batch.columns]
            return pa.RecordBatch.from_arrays([*columns, pa.array(np.tile(np.arange(forest.trees, dtype=np.int32), batch.num_rows)), pa.array(strings.ravel())], names=[*batch.schema.names, "tree", "string"])

        out = arrow_map(df, make, f"cid bigint, vec binary{extra}, tree int, string bigint")
        return out.withColumn("segment", F.shiftright("string", forest.bits - level))

    entries, queries = hashed(classes.select("cid", "vec"), False, ""), hashed(asked, True, ", least int")
    key = ["tree", "segment"]
    counts = entries.select(*key, F.lit(1).alias("n"), F.lit(0).alias("q")).union(queries.select(*key, F.lit(0), F.lit(1)))
    sizes = counts.groupBy(*key).agg(F.ceil(F.sum("n") / CHUNK).cast("int").alias("chunks"), F.ceil(F.sum("q") / QUERY_BLOCK).cast("int").alias("blocks"))
    sizes = staged(sizes.where("chunks > 0 AND blocks > 0"), "forest-segments")

    def spread(df: DataFrame, own: str, n_own: str, other: str, n_other: str) -> DataFrame:
        placed = df.join(sizes, key).withColumn(own, F.pmod(F.xxhash64("cid"), F.col(n_own)).cast("int"))
        return placed.withColumn(other, F.explode(F.sequence(F.lit(0), F.col(n_other) - 1))).drop("chunks", "blocks")

    return spread(entries, "chunk", "chunks", "block", "blocks"), spread(queries, "block", "blocks", "chunk", "chunks")


PLACE = ("tree", "segment", "chunk", "block")


def _ranges(entries: np.ndarray, string: int, length: int, bits: int) -> tuple[int, int]:
    """Bounds of the entries, in sorted order, that share ``length`` leading bits with ``string``."""
    low = string >> (bits - length) << (bits - length)
    return int(np.searchsorted(entries, low)), int(np.searchsorted(entries, low + (1 << (bits - length))))


def _search(classes: DataFrame, asked: DataFrame, forest: Forest, dim: int, kind: str, level: int, enough: int, k: int) -> DataFrame:
    """(asked, cid, score): the best k + 1 entries of every asked vector among its candidates, several times if several trees find them."""
    bits = forest.bits
    blank = asked.select("cid", "vec", F.lit(0).alias("least"))
    depth = bits - level + 1

    def measure(left: pa.Table, right: pa.Table) -> pa.Table:
        strings = np.sort(left["string"].to_numpy())
        rows = []
        for s in right["string"].to_numpy().tolist():
            bounds = (_ranges(strings, s, length, bits) for length in range(level, bits + 1))
            rows.append([b - a for a, b in bounds])
        return pa.table({"cid": right["cid"], "sizes": pa.array(rows, pa.list_(pa.int64()))})

    entries, queries = _dealt(classes, blank, forest, dim, kind, level)
    slim = entries.select("string", *PLACE).groupBy(*PLACE).cogroup(queries.select("cid", "string", *PLACE).groupBy(*PLACE))
    measured = slim.applyInArrow(measure, "cid bigint, sizes array<bigint>")
    totals = measured.groupBy("cid").agg(*[F.sum(F.col("sizes")[i]).alias(f"s{i}") for i in range(depth)])
    reached = sum((F.when(F.col(f"s{i}") >= enough, 1).otherwise(0) for i in range(1, depth)), F.lit(0))
    ascended = staged(totals.select("cid", (F.lit(level) + reached).cast("int").alias("least")), "forest-levels")

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({"asked": pa.array([], pa.int64()), "cid": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        order = np.argsort(left["string"].to_numpy(), kind="stable")
        strings, cid = left["string"].to_numpy()[order], left["cid"].to_numpy()[order]
        x, q = _matrix(left["vec"], kind, dim)[order], _matrix(right["vec"], kind, dim)
        out_q, out_c, out_s = [], [], []
        for i, (s, name, length) in enumerate(zip(right["string"].to_pylist(), right["cid"].to_pylist(), right["least"].to_pylist(), strict=True)):
            low, high = _ranges(strings, s, length, bits)
            scores = x[low:high] @ q[i]
            best = _best(scores, cid[low:high], k + 1)
            out_q.append(np.full(len(best), name))
            out_c.append(cid[low:high][best])
            out_s.append(scores[best])
        return pa.table({"asked": np.concatenate(out_q), "cid": np.concatenate(out_c), "score": np.concatenate(out_s)})

    entries, queries = _dealt(classes, asked.join(ascended, "cid").select("cid", "vec", "least"), forest, dim, kind, level)
    met = entries.select("cid", "vec", "string", *PLACE).groupBy(*PLACE).cogroup(queries.select("cid", "vec", "least", "string", *PLACE).groupBy(*PLACE))
    return met.applyInArrow(compare, "asked bigint, cid bigint, score double")


def nearest(vectors: DataFrame, every: int = 20, k: int = 20, vec: str = "embedding", vec_id: str = "vec_id", sample: int = SAMPLE, target: float = TARGET) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of every vector whose id is divisible by ``every``, by inner product, ties to the smaller id.

    See ``usable`` for the rows that take part.  A query never finds itself.  Queries that find fewer than k others in the forest, although there are more,
    are compared with all vectors.  A table without usable vectors gives no rows.
    """
    rows, dim, kind = usable(vectors, vec, vec_id)
    rows = staged(rows, "vectors")
    divisible = F.col("vec_id") % every == 0
    classes = staged(rows.groupBy("vec").agg(F.min("vec_id").alias("cid"), F.max(divisible).alias("asked")).select("cid", "vec", "asked"), "forest-classes")
    named = staged(rows.join(classes.select("cid", "vec"), "vec").select("vec_id", "cid"), "forest-names")
    members = named.withColumn("r", F.row_number().over(Window.partitionBy("cid").orderBy("vec_id"))).where(F.col("r") <= k + 1).drop("r")

    def length(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = _matrix(batch.column(0), kind, dim)
        return pa.RecordBatch.from_arrays([pa.array([float(np.sqrt((x * x).sum(axis=1).max(initial=0.0)))])], names=["longest"])

    longest = arrow_map(classes.select("vec"), length, "longest double").agg(F.max("longest")).first()[0] or 0.0
    forest = Forest(dim, longest)
    level, enough = _calibrate(classes, forest, dim, kind, k, sample, target)
    asked = classes.where("asked").select("cid", "vec")
    floor = max(0, level - 1)
    top = lambda found: found.distinct().withColumn("r", F.row_number().over(Window.partitionBy("asked").orderBy(F.desc("score"), "cid"))).where(F.col("r") <= k + 1).drop("r")
    found = staged(top(_search(classes, asked, forest, dim, kind, floor, enough, k).groupBy("asked", "cid").agg(F.max("score").alias("score"))), "forest-found")
    listed = found.join(members, "cid").groupBy("asked").agg(F.count("*").alias("n"))
    others = rows.count() - 1
    short = asked.join(listed.where(F.col("n") >= min(k, others) + 1), F.col("asked") == F.col("cid"), "left_anti").select("cid", "vec")
    short = staged(short, "forest-short")
    if floor and short.count():
        rest = top(_search(classes, short, forest, dim, kind, 0, 1 << 62, k).groupBy("asked", "cid").agg(F.max("score").alias("score")))
        found = found.join(short.select(F.col("cid").alias("asked")), "asked", "left_anti").unionByName(rest)
    spread = found.join(members, "cid").select("asked", "vec_id", "score")
    best = spread.withColumn("r", F.row_number().over(Window.partitionBy("asked").orderBy(F.desc("score"), "vec_id"))).where(F.col("r") <= k + 1)
    lists = best.groupBy("asked").agg(F.array_sort(F.collect_list(F.struct("r", "vec_id", "score"))).alias("best"))
    queries = named.where(divisible).select(F.col("vec_id").alias("query_id"), "cid")
    kept = F.slice(F.filter("best", lambda b: b["vec_id"] != F.col("query_id")), 1, k)
    ranked = queries.join(lists, F.col("cid") == F.col("asked")).select("query_id", F.posexplode(kept).alias("p", "b"))
    return ranked.select("query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("b.vec_id").alias("vec_id"), F.col("b.score").alias("score"))
