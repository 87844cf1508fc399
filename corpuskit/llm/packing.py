"""Best-fit packing into sequences of several permitted lengths.

Documents longer than the longest sequence are cut into full pieces and a rest; every piece is placed once, nothing is cut otherwise.
Pieces are dealt at random, by a hash, to groups (one for every ``GROUP`` documents), and each group is packed in one task by best-fit decreasing: a piece goes to
the open bin with the least room that still holds it.  Where no bin has room, the bin size is opened whose cost per word that it can still be
given (this piece and what smaller pieces remain) is least.  When a group is done, each bin shrinks to the shortest permitted length that holds its contents.
A sequence of n words costs ``n + n * n / QUADRATIC`` by default: linear work plus attention.
"""

from __future__ import annotations

import bisect
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuskit.llm.common import n_words

LENGTHS = (256, 512, 1024, 2048, 4096)
GROUP = 20_000
QUADRATIC = 16_384


def sequence_cost(n: int) -> float:
    return n + n * n / QUADRATIC


def pack_group(pieces: np.ndarray, lengths: tuple[int, ...], cost: Callable[[int], float] = sequence_cost) -> tuple[np.ndarray, np.ndarray, list[int], list[int]]:
    """Bin and start of each piece (given in decreasing size), and capacity and contents of each bin."""
    top = lengths[-1]
    rooms: list[list[int]] = [[] for _ in range(top + 1)]  # bins by room
    occupied: list[int] = []  # rooms that some bin has, ascending
    capacity: list[int] = []
    filled: list[int] = []
    bins, starts = np.empty(len(pieces), dtype=np.int64), np.empty(len(pieces), dtype=np.int64)
    left = int(pieces.sum())
    for k, size in enumerate(pieces.tolist()):
        at = bisect.bisect_left(occupied, size)
        if at < len(occupied):
            room = occupied[at]
            b = rooms[room].pop()
            if not rooms[room]:
                del occupied[at]
        else:
            fits = [c for c in lengths if c >= size]
            b = len(capacity)
            capacity.append(min(fits, key=lambda c: (cost(c) / min(c, left), c)))
            filled.append(0)
            room = capacity[b]
        bins[k], starts[k] = b, filled[b]
        filled[b] += size
        left -= size
        room -= size
        if room:
            if not rooms[room]:
                bisect.insort(occupied, room)
            rooms[room].append(b)
    return bins, starts, [min(c for c in lengths if c >= n) for n in filled], filled


def pack(docs: DataFrame, text: str = "text", lengths: tuple[int, ...] = LENGTHS, group: int = GROUP, seed: int = 7) -> DataFrame:
    """(doc_id, piece, piece_start, length, bin, bin_start, bin_length, bin_filled): one row per piece of every document, in words.

    ``piece_start`` counts words of the document before the piece, ``bin_start`` words of the bin before it; ``bin`` names a bin across all groups.
    Null and empty texts have no words: they give one row of length 0 without a bin (null).  Rows with null or repeated ids, and copies of a row, are packed
    like others.  Extra columns of ``docs`` are ignored.  Reruns agree: pieces of equal size are ordered by id, piece and a hash of the text.
    """
    lengths = tuple(sorted(set(lengths)))
    top = lengths[-1]
    known = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), n_words(F.col(text)).alias("words"), F.xxhash64(F.col(text)).alias("mark"))
    pieces = known.where("words > 0").select(
        "doc_id", "mark", "words", F.posexplode(F.sequence(F.lit(0), F.col("words") - 1, F.lit(top))).alias("piece", "piece_start")
    ).withColumn("length", F.least(F.lit(top), F.col("words") - F.col("piece_start")))
    groups = max(1, -(-docs.count() // group))
    dealt = pieces.withColumn("part", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "mark", "piece"), F.lit(groups)).cast("int"))

    def place(table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("mark", "ascending")])
        bins, starts, sizes, filled = pack_group(table["length"].to_numpy(), lengths)
        part = table["part"].to_pylist()[:1]
        out = table.select(["doc_id", "piece", "piece_start", "length"])
        columns = {
            "bin": pa.array([f"{part[0]}-{b}" for b in bins.tolist()], pa.string()),
            "bin_start": pa.array(starts.astype(np.int32)),
            "bin_length": pa.array(np.array(sizes, dtype=np.int32)[bins]),
            "bin_filled": pa.array(np.array(filled, dtype=np.int32)[bins]),
        }
        for name, values in columns.items():
            out = out.append_column(name, values)
        return out

    schema = "doc_id bigint, piece int, piece_start int, length int, bin string, bin_start int, bin_length int, bin_filled int"
    placed = dealt.select("part", "doc_id", "piece", "piece_start", "length", "mark").groupBy("part").applyInArrow(place, schema)
    none = known.where("words = 0").select(
        "doc_id", F.lit(0).alias("piece"), F.lit(0).alias("piece_start"), F.lit(0).alias("length"), F.lit(None).cast("string").alias("bin"),
        F.lit(None).cast("int").alias("bin_start"), F.lit(None).cast("int").alias("bin_length"), F.lit(None).cast("int").alias("bin_filled"),
    )
    return placed.unionByName(none)
