"""Groups of spelling variants: every word with its neighbours of one inserted, deleted or replaced character.

The index is sliced by bits: for each (position, letter) a bitset over an ordered vocabulary says which words have that letter there.  One pass over the
letters of a query carries four bitsets along, for all words at once: those without an error so far, and those with one replacement, one insertion or one deletion, whose
letters are met one position later or earlier from there on.  The words stand in the order in which a form is chosen, so the best neighbour is the lowest
bit of the result and the number of neighbours its bit count.

No index holds the whole vocabulary.  One error leaves the first half or the rest of a word whole, so words meet in blocks by (length, half) only; a
word of m letters is in the blocks of length m, where it is as long as the shorter word of a pair, and m - 1, where it is the longer one.  Pairs that agree in
the first half are left to its block, so each is found once.  A block above ``TILE`` words is dealt into slices, and every slice of queries meets every slice of
the index.

Words are counted per task and then per word; those that can't reach ``SHORTEST`` characters are never made.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuskit.session import staged

SHORTEST = 7
LEAST = 2
RATIO = 10
EVERY = 31
TILE = 4096
FLUSH = 400_000
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_RUN = re.compile("[A-Za-zÀ-ÿ]{%d,}" % SHORTEST)  # whole runs: shorter ones can't give a word


def count_words(docs: DataFrame, text: str = "text", least: int = LEAST) -> DataFrame:
    """(word, n): runs of letters, lower-cased in ASCII, of which one in ``EVERY`` (by a hash of document and run) lacks a letter; at least ``least`` in all."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

        for b in batches:
            for doc_id, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                for run, n in Counter(_RUN.findall((raw or "").translate(_LOWER))).items():
                    h = zlib.crc32(run.encode(), start)
                    if h % EVERY == 0:
                        at = h % len(run)
                        run = run[:at] + run[at + 1 :]
                        if len(run) < SHORTEST:
                            continue
                    counts[run] += n
                if len(counts) >= FLUSH:
                    yield rows()
                    counts.clear()
        yield rows()

    found = docs.select(F.col("doc_id").cast("string"), F.col(text)).mapInArrow(count, "word string, n bigint")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


class SlicedIndex:
    """Bitsets over ``words``: by (position, letter) and by length."""

    def __init__(self, words: list[str]) -> None:
        at: dict[tuple[int, str], int] = {}
        of_length: dict[int, int] = {}
        for i, word in enumerate(words):
            bit = 1 << i
            for place in enumerate(word):
                at[place] = at.get(place, 0) | bit
            of_length[len(word)] = of_length.get(len(word), 0) | bit
        self.at, self.of_length, self.every = at, of_length, (1 << len(words)) - 1

    def near(self, word: str, half: int = 0) -> tuple[int, int, int]:
        """(equal length, one longer, one shorter): the words one error away, as bitsets; without those that agree in the first ``half`` letters, if any."""
        at = self.at.get
        exact, replaced, inserted, deleted = self.every, 0, 0, 0
        same_half = 0
        for i, letter in enumerate(word):
            here = at((i, letter), 0)
            inserted = (inserted | exact) & at((i + 1, letter), 0)
            deleted = exact | (deleted & at((i - 1, letter), 0))
            replaced = (replaced & here) | (exact & ~here)
            exact &= here
            if i + 1 == half:
                same_half = exact
            if not (exact or replaced or inserted or deleted):
                return 0, 0, 0
        length = self.of_length.get
        m = len(word)
        return tuple(found & ~same_half for found in (replaced & length(m, 0), (inserted | exact) & length(m + 1, 0), deleted & length(m - 1, 0)))


def compare_tile(side: int, shorter: int, index: list[tuple[str, int]], queries: list[str]) -> Iterator[tuple[str, int, str, int]]:
    """(word, number of neighbours, the best one, its count) for the queries with neighbours; ``index`` holds (word, n).

    ``shorter`` is the length of the shorter word of the block's pairs; ``side`` 0 is the block of a first half, 1 that of the rest.
    """
    ordered = sorted(index, key=lambda x: (-x[1], x[0]))
    sliced = SlicedIndex([w for w, _ in ordered])
    for word in queries:
        equal, longer, less = sliced.near(word, shorter // 2 if side else 0)
        found = equal | longer if len(word) == shorter else less
        if found:
            best, n = ordered[(found & -found).bit_length() - 1]
            yield word, found.bit_count(), best, n


BOTH, INDEX, QUERY = 0, 1, 2


def neighbours(words: DataFrame, tile: int = TILE) -> DataFrame:
    """(word, n_near, near, near_n): the number of near words and the one with the largest count, ties to the smaller word; only words that have any."""
    size = F.length("word")

    def keys(shorter):
        half = F.floor(shorter / 2).cast("int")
        first, rest = F.substring("word", F.lit(1), half), F.substring("word", size - shorter + half + 1, shorter - half)
        return [F.struct(F.lit(side).alias("side"), shorter.alias("shorter"), part.alias("part")) for side, part in enumerate((first, rest))]

    filed = words.select("word", "n", F.explode(F.array(*keys(size), *keys(size - 1))).alias("k")).select("word", "n", "k.*")
    key = ["side", "shorter", "part"]
    sizes = filed.groupBy(*key).agg(F.count("*").alias("held"), F.count_if(size == F.col("shorter")).alias("short"))
    # a pair needs a word of the shorter length
    slices = sizes.where("held > 1 AND short > 0").select(*key, F.ceil(F.col("held") / tile).cast("int").alias("slices"))
    placed = filed.join(slices, key).withColumn("own", F.pmod(F.xxhash64("word"), F.col("slices")).cast("int"))
    others = F.sequence(F.lit(0), F.col("slices") - 1)
    whole = F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(BOTH).alias("role")))
    asked = F.transform(others, lambda o: F.struct(F.col("own").alias("i"), o.alias("j"), F.lit(QUERY).alias("role")))
    listed = F.transform(others, lambda o: F.struct(o.alias("i"), F.col("own").alias("j"), F.lit(INDEX).alias("role")))
    tiles = placed.select(*key, "word", "n", F.explode(F.when(F.col("slices") == 1, whole).otherwise(F.concat(asked, listed))).alias("t"))
    tiles = tiles.select(*key, "t.i", "t.j", "t.role", "word", "n")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Tiles are runs of rows with the same key; a run may go on in the next batch."""
        now, held, out = None, [], []

        def close() -> None:
            if len(held) > 1:
                index = [(w, n) for w, n, role in held if role != QUERY]
                out.extend(compare_tile(now[0], now[1], index, [w for w, _, role in held if role != INDEX]))

        def rows() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) or [[], [], [], []]
            types = (pa.string(), pa.int64(), pa.string(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["word", "n_near", "near", "near_n"])

        for b in batches:
            for *place, role, word, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if place != now:
                    close()
                    now, held = place, []
                held.append((word, n, role))
            if len(out) > 50_000:
                yield rows()
                out.clear()
        close()
        yield rows()

    place = [*key, "i", "j"]
    dealt = tiles.repartition(*place).sortWithinPartitions(*place)
    found = dealt.mapInArrow(compare, "word string, n_near bigint, near string, near_n bigint")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), "near", "near_n"))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best")).select("word", "n_near", "best.near", "best.near_n")


def follow(forms: DataFrame) -> DataFrame:
    """(word, root) from (word, form): the last form of each chain.  Chains are halved until none goes on; counts grow along them, so they have ends."""
    roots = staged(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        further = roots.select(F.col("word").alias("root"), F.col("root").alias("far"))
        moved = roots.join(further, "root", "left").select("word", F.coalesce("far", "root").alias("root"), F.col("far").isNotNull().alias("open"))
        moved = staged(moved, "spelling-roots")
        roots = moved.select("word", "root")
        if moved.where("open").isEmpty():
            return roots


def group_spellings(docs: DataFrame, text: str = "text", ratio: int = RATIO, tile: int = TILE) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every word of ``count_words``.

    A form is the near word of the largest count (ties to the first in code-point order) if that is at least ``ratio`` times the word's own; the root is the last of the
    chain of forms, the word itself without any.  Null texts hold no words; a null id counts as the empty text in the hash.  Repeated rows count each, other columns
    are ignored, and an empty table gives no rows.  Words of any length take part.
    """
    words = staged(count_words(docs, text), "spelling-words")
    near = words.join(neighbours(words, tile), "word", "left")
    has_form = F.col("near_n") >= ratio * F.col("n")
    formed = staged(
        near.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(has_form, F.col("near")).alias("form"), F.when(has_form, F.col("near_n")).alias("form_n")), "spelling-forms"
    )
    roots = follow(formed.where("form IS NOT NULL"))
    return formed.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
