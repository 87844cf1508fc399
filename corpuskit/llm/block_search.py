"""Exact top-k search by integer inner product with block-at-a-time pruning.

Vectors become integers, floor(256 x).  Equal vectors are one entry with its least ids.  Entries are sorted by a locality key (the nearest of some pivots, then the nearness) and cut
into blocks of consecutive entries; a block holds its forward index (the integers of its vectors) and the largest and smallest value of every
component.  A query's bound for a block is the sum over components of its value times that maximum, or minimum where its value is negative: no vector of the
block scores more.

Blocks are written shard by shard.  A query meets a shard only if the shard's own bound reaches the query's threshold, the k-th score within
its own block.  In a tile (a shard and a group of queries) each query goes through the blocks in the order of their bounds, scores all their vectors, and stops at the first
bound below its k-th score.  Nothing is left out: vectors without structure have bounds above every score, and are scored in full.

Products are summed in double precision where they are exact, and in Python integers where components are too large for that.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuskit.session import staged

BLOCK = 512
SHARD = 32_768
MAX_SHARDS = 4096
GROUP = 16_384
PIVOTS = 128  # the sample that orders the entries; it decides speed only
_LARGEST = 2.0**62


def _packed(rows: np.ndarray) -> list[bytes]:
    """Each row as 16-bit integers where they suffice, else 64-bit."""
    small = np.abs(rows).max(axis=1, initial=0) < 1 << 15 if rows.size else np.ones(len(rows), dtype=bool)
    return [r.astype("<i2" if s else "<i8").tobytes() for r, s in zip(rows, small.tolist(), strict=True)]


def _unpacked(raw: list[bytes], dim: int) -> np.ndarray:
    out = np.empty((len(raw), dim), dtype=np.int64)
    for i, b in enumerate(raw):
        out[i] = np.frombuffer(b, dtype="<i2" if len(b) == 2 * dim else "<i8")
    return out


def as_integers(vectors: DataFrame, vec: str = "embedding", vec_id: str = "vec_id") -> DataFrame:
    """(vec_id, dim, ints): rows that take part.

    Null ids and vectors that are null or hold null or non-finite components take no part.  Of rows with the same id the least vector counts.  Components
    beyond 2^62 count as 2^62.
    """
    fine = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    numbers = F.transform(vec, lambda x: x.cast("double"))
    rows = vectors.where(F.col(vec_id).isNotNull() & F.coalesce(fine, F.lit(False))).select(F.col(vec_id).cast("bigint").alias("vec_id"), numbers.alias("vec"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column = b.column(1)
            sizes = np.asarray(column.value_lengths().to_numpy(zero_copy_only=False), dtype=np.int64)
            with np.errstate(over="ignore"):
                flat = np.clip(np.floor(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * 256), -_LARGEST, _LARGEST).astype(np.int64)
            ends = np.cumsum(sizes)
            ints = [_packed(flat[e - s : e].reshape(1, -1))[0] for s, e in zip(sizes.tolist(), ends.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes.astype(np.int32)), pa.array(ints, pa.binary())], names=["vec_id", "dim", "ints"])

    packed = rows.mapInArrow(pack, "vec_id bigint, dim int, ints binary")
    return packed.groupBy("vec_id").agg(F.min(F.struct("dim", "ints")).alias("v")).select("vec_id", "v.dim", "v.ints")


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of all rows of ``a`` with all of ``b``; what passes 64 bits is cut to them."""
    m = min(a.shape[1], b.shape[1])
    a, b = a[:, :m], b[:, :m]
    if float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * m < 2.0**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    exact = a.astype(object) @ b.astype(object).T
    return np.clip(exact, -(1 << 63), (1 << 63) - 1).astype(np.int64)


def block_bounds(queries: np.ndarray, high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Upper bounds of the scores: one row per query, one column per block; a little above, for what rounding takes."""
    m = min(queries.shape[1], high.shape[1])
    q = queries[:, :m].astype(np.float64)
    bounds = np.maximum(q, 0) @ high[:, :m].astype(np.float64).T + np.minimum(q, 0) @ low[:, :m].astype(np.float64).T
    return bounds + np.abs(bounds) * 1e-9 + 1


def _kth(scores: np.ndarray, k: int) -> np.ndarray:
    """The k-th largest of each row, the least 64-bit number where there are fewer."""
    if scores.shape[1] < k:
        return np.full(len(scores), np.iinfo(np.int64).min)
    return np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]


class Best:
    """The k best (score, smaller id first) of each of n queries."""

    def __init__(self, thresholds: np.ndarray, k: int) -> None:
        self.k, self.kth = k, thresholds.copy()
        self.query, self.score, self.cid = (np.zeros(0, dtype=np.int64) for _ in range(3))

    def add(self, rows: np.ndarray, scores: np.ndarray, cids: np.ndarray) -> None:
        at, column = np.nonzero(scores >= self.kth[rows, None])
        if not len(at):
            return
        query = np.concatenate([self.query, rows[at]])
        score, cid = np.concatenate([self.score, scores[at, column]]), np.concatenate([self.cid, cids[column]])
        order = np.lexsort((cid, ~score, query))  # ~ turns the order of all 64-bit numbers around
        query, score, cid = query[order], score[order], cid[order]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        last = query[place == self.k - 1]
        self.kth[last] = np.maximum(self.kth[last], score[place == self.k - 1])
        kept = place < self.k
        self.query, self.score, self.cid = query[kept], score[kept], cid[kept]


def search_tile(queries: np.ndarray, thresholds: np.ndarray, blocks: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]], k: int) -> tuple[Best, int]:
    """Best entries of ``blocks`` (ids, vectors, maxima, minima; of one length) for each query, and how many (query, block) pairs were scored."""
    bounds = block_bounds(queries, np.stack([b[2] for b in blocks]), np.stack([b[3] for b in blocks]))
    order = np.argsort(-bounds, axis=1, kind="stable")
    best, scored = Best(thresholds, k), 0
    going = np.arange(len(queries))
    for step in range(len(blocks)):
        at = order[going, step]
        going, at = (x[bounds[going, at] >= best.kth[going]] for x in (going, at))
        if not len(going):
            break
        scored += len(going)
        for b in np.unique(at).tolist():
            rows = going[at == b]
            best.add(rows, _products(queries[rows], blocks[b][1]), blocks[b][0])
    return best, scored


def _pivots(classes: DataFrame, number: int) -> list[tuple[int, bytes]]:
    rows = classes.orderBy(F.xxhash64("cid"), "cid").limit(number).select("dim", "ints").collect()  # PIVOTS rows at most
    return [(r["dim"], bytes(r["ints"])) for r in rows]


def write_blocks(classes: DataFrame, k: int, block: int, shards: int) -> DataFrame:
    """One row per block (shard, block, dim, cids, vectors, high, low, asked, kth) and, with block -1, one per shard and length with its maxima and minima.

    ``classes`` is (cid, dim, ints, asked); ``asked`` lists the places of queries in the block and ``kth`` their k-th score in it.
    """
    pivots = _pivots(classes, PIVOTS)
    dims = sorted({d for d, _ in pivots})

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = {d: _unpacked([p for e, p in pivots if e == d], d).astype(np.float64) for d in dims}
        for b in batches:
            keys = []
            for dim, raw in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                if not dim or dim not in known:
                    keys.append(0)
                    continue
                x, p = _unpacked([raw], dim)[0].astype(np.float64), known[dim]
                near = p @ x / (np.linalg.norm(p, axis=1) * np.linalg.norm(x) + 1e-300)
                at = int(np.argmax(near))
                keys.append(at * 1_000_000 + int((1 - min(1.0, max(-1.0, float(near[at])))) * 400_000))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(keys, pa.int64())], names=[*b.schema.names, "near"])

    keyed = classes.select("cid", "dim", "ints", "asked").mapInArrow(place, "cid bigint, dim int, ints binary, asked boolean, near bigint")
    order = ["dim", "near", "cid"]
    ordered = keyed.repartitionByRange(shards, *order).sortWithinPartitions(*order)
    schema = "shard int, block int, dim int, cids binary, vectors binary, high binary, low binary, asked binary, kth binary"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, number = TaskContext.get().partitionId(), 0
        whole: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        held: list[tuple] = []

        def close() -> pa.RecordBatch:
            nonlocal number
            dim = held[0][1]
            ids, x = np.array([h[0] for h in held], dtype="<i8"), _unpacked([h[2] for h in held], dim)
            high, low = x.max(axis=0), x.min(axis=0)
            seen = whole.get(dim)
            whole[dim] = (high, low) if seen is None else (np.maximum(high, seen[0]), np.minimum(low, seen[1]))
            asked = np.flatnonzero([h[3] for h in held])
            kth = _kth(_products(x[asked], x), k)
            raw = b"".join(r.astype("<i8").tobytes() for r in x) if np.abs(x).max(initial=0) >= 1 << 15 else x.astype("<i2").tobytes()
            row = (shard, number, dim, ids.tobytes(), raw, high.astype("<i8").tobytes(), low.astype("<i8").tobytes(), asked.astype("<i8").tobytes(), kth.astype("<i8").tobytes())
            number += 1
            return _row(row)

        def _row(row: tuple) -> pa.RecordBatch:
            types = [pa.int32()] * 3 + [pa.binary()] * 6
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types, strict=True)], names=[f.split()[0] for f in schema.split(", ")])

        for b in batches:
            for row in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                if held and (len(held) >= block or row[1] != held[0][1]):
                    yield close()
                    held = []
                held.append(row)
        if held:
            yield close()
        for dim, (high, low) in whole.items():
            yield _row((shard, -1, dim, b"", b"", high.astype("<i8").tobytes(), low.astype("<i8").tobytes(), b"", b""))

    return staged(ordered.mapInArrow(cut, schema), "search-blocks")


def _matrix(raw: bytes, dim: int, rows: int) -> np.ndarray:
    return np.frombuffer(raw, dtype="<i2" if len(raw) == 2 * dim * rows else "<i8").reshape(rows, dim)


def _asked(blocks: DataFrame, k: int) -> DataFrame:
    """(cid, dim, ints, kth, shard): every query with each shard whose bound reaches its threshold."""
    # one row per shard and length: MAX_SHARDS, and as many more as there are lengths
    whole = [(r["shard"], r["dim"], bytes(r["high"]), bytes(r["low"])) for r in blocks.where("block < 0").select("shard", "dim", "high", "low").collect()]
    types = (pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int32())

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = sorted({d for _, d, _, _ in whole})
        shards = {d: [w for w in whole if w[1] == d] for d in lengths}
        limits = {d: [np.frombuffer(b"".join(w[i] for w in ws), dtype="<i8").reshape(len(ws), d) for i in (2, 3)] for d, ws in shards.items()}
        for b in batches:
            for dim, cids, vectors, asked, kth in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                ids, at = np.frombuffer(cids, dtype="<i8"), np.frombuffer(asked, dtype="<i8")
                if not len(at):
                    continue
                x, least = _matrix(vectors, dim, len(ids))[at], np.frombuffer(kth, dtype="<i8")
                raw, met = _packed(x.astype(np.int64)), set()
                for d, (high, low) in limits.items():
                    for q, s in zip(*np.nonzero(block_bounds(x, high, low) >= least[:, None]), strict=True):
                        met.add((int(q), shards[d][s][0]))
                rows = [(int(ids[at[q]]), dim, raw[q], int(least[q]), s) for q, s in sorted(met)]
                columns = zip(*rows, strict=True) if rows else [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["cid", "dim", "ints", "kth", "shard"])

    rows = blocks.where("block >= 0").select("dim", "cids", "vectors", "asked", "kth")
    return rows.mapInArrow(meet, "cid bigint, dim int, ints binary, kth bigint, shard int")


def search(blocks: DataFrame, n_asked: int, k: int) -> DataFrame:
    """(asked, cid, score): the k best entries of every shard for every query that meets it."""
    groups = max(1, -(-n_asked // GROUP))
    queries = _asked(blocks, k).withColumn("team", F.pmod(F.xxhash64("cid"), F.lit(groups)).cast("int"))
    data = blocks.where("block >= 0").select("shard", "dim", "cids", "vectors", "high", "low", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("team"))

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        found = [np.zeros((3, 0), dtype=np.int64)]
        held: dict[int, list] = {}
        for dim, cids, *raw in zip(*(left[c].to_pylist() for c in ("dim", "cids", "vectors", "high", "low")), strict=True):
            ids = np.frombuffer(cids, dtype="<i8")
            held.setdefault(dim, []).append((ids, _matrix(raw[0], dim, len(ids)), *(np.frombuffer(r, dtype="<i8") for r in raw[1:])))
        lengths, names = right["dim"].to_numpy(), right["cid"].to_numpy()
        raws, least = right["ints"].to_pylist(), right["kth"].to_numpy()
        for dim in np.unique(lengths).tolist():
            mine = np.flatnonzero(lengths == dim)
            x = _unpacked([raws[i] for i in mine], dim)
            for blocks_ in held.values():
                best, _ = search_tile(x, least[mine], blocks_, k)
                found.append(np.stack([names[mine][best.query], best.cid, best.score]))
        out = np.concatenate(found, axis=1)
        return pa.table({"asked": out[0], "cid": out[1], "score": out[2]})

    tiles = data.groupBy("shard", "team").cogroup(queries.groupBy("shard", "team"))
    return tiles.applyInArrow(compare, "asked bigint, cid bigint, score bigint")


def top_scores(vectors: DataFrame, every: int = 50, k: int = 5, vec: str = "embedding", vec_id: str = "vec_id", block: int = BLOCK, shard: int = SHARD) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest scores of every vector whose id is divisible by ``every`` against all others, ties to the smaller id.

    See ``as_integers`` for the rows that take part; zero vectors do.  Vectors of different lengths are compared as if the shorter ended in zeros.  A query
    never finds itself, but an equal vector of another id.  All others are returned if there are fewer than k.  An empty table gives no rows.
    """
    rows = staged(as_integers(vectors, vec, vec_id), "search-vectors")
    divisible = F.col("vec_id") % every == 0
    equal = ["dim", "ints"]
    least = rows.withColumn("r", F.row_number().over(Window.partitionBy(*equal).orderBy("vec_id"))).where(F.col("r") <= k + 1)
    named = least.groupBy(*equal).agg(F.array_sort(F.collect_list("vec_id")).alias("members")).withColumn("cid", F.col("members")[0])
    wanted = rows.where(divisible).groupBy(*equal).agg(F.lit(True).alias("asked"))
    classes = staged(named.join(wanted, equal, "left").select("cid", *equal, "members", F.coalesce("asked", F.lit(False)).alias("asked")), "search-classes")
    facts = classes.agg(F.count("*").alias("n"), F.count_if("asked").alias("asked")).first()
    blocks = write_blocks(classes, k + 1, block, max(1, min(MAX_SHARDS, -(-facts["n"] // shard))))
    found = search(blocks, facts["asked"], k + 1)
    best = found.withColumn("r", F.row_number().over(Window.partitionBy("asked").orderBy(F.desc("score"), "cid"))).where(F.col("r") <= k + 1)
    spread = best.join(classes.select("cid", "members"), "cid").select("asked", "score", F.explode("members").alias("vec_id"))
    ranked = spread.withColumn("r", F.row_number().over(Window.partitionBy("asked").orderBy(F.desc("score"), "vec_id"))).where(F.col("r") <= k + 1)
    lists = ranked.groupBy("asked").agg(F.array_sort(F.collect_list(F.struct("r", "vec_id", "score"))).alias("best"))
    queries = rows.where(divisible).join(classes.select("cid", *equal), equal).select(F.col("vec_id").alias("query_id"), F.col("cid").alias("asked"))
    kept = F.slice(F.filter("best", lambda b: b["vec_id"] != F.col("query_id")), 1, k)
    out = queries.join(lists, "asked").select("query_id", F.posexplode(kept).alias("p", "b"))
    return out.select("query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("b.vec_id").alias("vec_id"), F.col("b.score").alias("score"))
