"""Scores of texts under a class-based bigram model with classes from exchange clustering.

Every word has a class, and every word seen at least ``LEAST`` times gets it by the likelihood of the class bigrams.  Clustering works at three scales, by how often a word
occurs, with one criterion: what a word gains in a class, given which classes stand before and after it.

* The ``SEQUENTIAL`` most frequent words are exchanged one after the other on the driver, from counts of a fixed size (units times classes), for a few rounds.
  All other words take part there as ``SUFFIXES`` units of words with the same last letters.
* The other words of the in-task list (``FREQUENT``) are exchanged in one batch: tasks send their contexts packed by word, reducers choose the class.
* All remaining words, however many, are met by word in a shuffled table of their occurrences: the group of a word counts its contexts, chooses its
  class and hands it to each occurrence.

Words seen less often keep the class of their suffix unit, as do words never seen.  The number of classes grows with the fourth root of the vocabulary.  The
probability of a text is the product of class transitions, smoothed towards class frequencies, and of word emissions
(count + 1/2) / (words of the class + (distinct words of the class + 1) / 2), so that a class keeps room for unseen words.

Texts are staged once as 16-bit ids with the words that have none; a transition between listed words is counted where the text is, one that touches another
word with that word's occurrence.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, fields
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuskit.llm.common import id_fold
from corpuskit.session import staged

FREQUENT = 60_000  # words that every task holds
SEQUENTIAL = 8_000
SUFFIXES = 2_000
LEAST = 2
ROUNDS = 4
FLUSH = 400_000
PULL = 5.0  # transitions count as much again as so many tokens of the class frequencies
REST = 255  # stands for the class of a neighbour that isn't listed; there are fewer classes


def number_of_classes(distinct: int) -> int:
    return int(min(200, max(16, round(2 * distinct**0.25))))


def suffix_unit(word: bytes) -> int:
    return zlib.crc32(word[-4:]) % SUFFIXES


def count_words(texts: DataFrame) -> DataFrame:
    """(word, suffix, n) over all texts of the binary column ``raw``."""

    def rows(counts: Counter) -> pa.RecordBatch:
        words = list(counts)
        return pa.RecordBatch.from_arrays(
            [pa.array(words, pa.binary()), pa.array([suffix_unit(w) for w in words], pa.int32()), pa.array(list(counts.values()), pa.int64())], names=["word", "suffix", "n"]
        )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for b in batches:
            for raw in b.column(0).to_pylist():
                counts.update((raw or b"").lower().split())
                if len(counts) >= FLUSH:
                    yield rows(counts)
                    counts = Counter()
        yield rows(counts)

    return texts.mapInArrow(count, "word binary, suffix int, n bigint").groupBy("word", "suffix").agg(F.sum("n").alias("n"))


def frequent_words(counts: DataFrame) -> DataFrame:
    """(word, n) of at most ``FREQUENT`` words, the most frequent ones down to a bin of counts that would exceed the limit.

    Bins hold counts that agree in their leading six bits, so there are a few hundred of them whatever the corpus, and no task has to rank all words.
    """
    bits = F.greatest(F.length(F.bin("n")).cast("int") - 6, F.lit(0))
    binned = counts.withColumn("low", F.call_function("shiftleft", F.call_function("shiftright", F.col("n"), bits), bits))
    total, least = 0, 1 << 62
    for row in sorted(binned.groupBy("low").count().collect(), key=lambda r: -r["low"]):
        total += row["count"]
        if total > FREQUENT:
            break
        least = row["low"]
    return counts.where(F.col("n") >= least).select("word", "n")


class Model:
    """What tasks need: ids of frequent words, the unit of each id and the class of each unit.

    Ids: 0 is the end of a text, then the frequent words, then one for each suffix unit of the other words.
    """

    def __init__(self, words: list[bytes], counts: list[int], classes: int) -> None:
        self.words, self.n_words = words, len(words)
        self.clustered = min(SEQUENTIAL, len(words))
        self.units = 1 + self.clustered + SUFFIXES
        self.log_counts = np.log10(np.array(counts, dtype=np.float64) + 0.5)
        own = np.arange(1, self.clustered + 1)
        later = np.array([1 + self.clustered + suffix_unit(w) for w in words[self.clustered :]], dtype=np.int64)
        self.unit = np.concatenate([[0], own, later, 1 + self.clustered + np.arange(SUFFIXES)])
        self.classes = classes
        self.of_unit = np.concatenate([[0], 1 + np.arange(self.units - 1) % (classes - 1)])

    def of_ids(self) -> np.ndarray:
        """The class of each id, by its unit."""
        return self.of_unit[self.unit]

    def of_suffix(self, word: bytes) -> int:
        return int(self.of_unit[1 + self.clustered + suffix_unit(word)])


def stage_ids(docs: DataFrame, model: Model, text: str) -> DataFrame:
    """(row, doc_id, held_out, ids, rest): ids of all tokens with the end, and the words that have no id of their own, joined by blanks."""
    words, first = model.words, 1 + model.n_words

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = {w: i for i, w in enumerate(words, 1)}
        row = TaskContext.get().partitionId() << 40
        for b in batches:
            packed, rests = [], []
            for raw in b.column(2).to_pylist():
                tokens = (raw or b"").lower().split()
                ids = np.fromiter(map(known.get, tokens, repeat(0)), dtype=np.uint16, count=len(tokens))
                unknown = np.flatnonzero(ids == 0).tolist()
                rest = [tokens[i] for i in unknown]
                ids[unknown] = [first + suffix_unit(w) for w in rest]
                packed.append(ids.tobytes() + b"\0\0")
                rests.append(b" ".join(rest))
            names = ["row", "doc_id", "held_out", "ids", "rest"]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(row, row + b.num_rows)), b.column(0), b.column(1), pa.array(packed, pa.binary()), pa.array(rests, pa.binary())], names=names)
            row += b.num_rows

    source = docs.select(F.col("doc_id").cast("bigint"), (id_fold(F.col("doc_id"), 5) == 1).alias("held_out"), F.col(text).cast("binary"))
    return staged(source.mapInArrow(encode, "row bigint, doc_id bigint, held_out boolean, ids binary, rest binary"), "brown-ids")


def neighbours(ids: DataFrame, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """(before, after): for each unit, how often each class stands before and after it, over all training texts."""
    unit, of_unit, k, size = model.unit, model.of_unit, model.classes, model.units

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, after = np.zeros(size * k, dtype=np.int64), np.zeros(size * k, dtype=np.int64)
        for b in batches:
            units = np.concatenate([[0], unit[np.frombuffer(b"".join(b.column(0).to_pylist()), dtype=np.uint16)]])
            own = of_unit[units]
            before += np.bincount(units[1:] * k + own[:-1], minlength=size * k)
            after += np.bincount(units[:-1] * k + own[1:], minlength=size * k)
            after[own[1]] -= 1  # the end that stands before the batch is no token of it
            after[of_unit[0]] += 1
        yield packed(before.reshape(size, k), after.reshape(size, k))

    def packed(before: np.ndarray, after: np.ndarray) -> pa.RecordBatch:
        """One row per unit that occurs: its cells that aren't zero, as (class, before, after)."""
        held, rows = [], []
        cell = np.dtype([("c", "u1"), ("b", "<u4"), ("a", "<u4")])
        for u in np.flatnonzero((before != 0).any(axis=1) | (after != 0).any(axis=1)).tolist():
            at = np.flatnonzero((before[u] != 0) | (after[u] != 0))
            cells = np.empty(len(at), dtype=cell)
            cells["c"], cells["b"], cells["a"] = at, before[u, at], after[u, at]
            held.append(u)
            rows.append(cells.tobytes())
        return pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array(rows, pa.binary())], names=["unit", "cells"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell = np.dtype([("c", "u1"), ("b", "<u4"), ("a", "<u4")])
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for u, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                cells = np.frombuffer(raw, dtype=cell)
                mine = sums.setdefault(u, np.zeros((2, k), dtype=np.int64))
                mine[0, cells["c"]] += cells["b"]
                mine[1, cells["c"]] += cells["a"]
        units = sorted(sums)
        raw = np.stack([sums[u] for u in units]).tobytes() if units else b""
        yield pa.RecordBatch.from_arrays([pa.array([np.array(units, dtype="<i4").tobytes()], pa.binary()), pa.array([raw], pa.binary())], names=["units", "sums"])

    sent = ids.where(~F.col("held_out")).select("ids").mapInArrow(count, "unit int, cells binary")
    before, after = np.zeros((size, k)), np.zeros((size, k))
    for row in sent.repartition("unit").mapInArrow(add, "units binary, sums binary").collect():  # units times classes cells at most
        units = np.frombuffer(row["units"], dtype="<i4")
        if len(units):
            before[units], after[units] = np.frombuffer(row["sums"], dtype="<i8").reshape(-1, 2, k).swapaxes(0, 1)
    return before, after


def _f(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-12))


def exchange(before: np.ndarray, after: np.ndarray, of_unit: np.ndarray, classes: int) -> np.ndarray:
    """One round of exchange: units in turn, most frequent first, move to the class with the best likelihood.  The end (unit 0) keeps class 0 for itself."""
    of_unit = of_unit.copy()
    totals = before.sum(axis=1)
    into, out, size = np.zeros((classes, before.shape[1])), np.zeros((classes, before.shape[1])), np.zeros(classes)
    np.add.at(into, of_unit, before)
    np.add.at(out, of_unit, after)
    np.add.at(size, of_unit, totals)
    f_into, f_out, f_size = _f(into), _f(out), _f(size)
    for u in np.argsort(-totals, kind="stable").tolist():
        if u == 0 or totals[u] == 0:
            continue
        b, a, c = before[u], after[u], of_unit[u]
        bs, as_ = np.flatnonzero(b), np.flatnonzero(a)
        into[c] -= b
        out[c] -= a
        size[c] -= totals[u]
        f_into[c], f_out[c], f_size[c] = _f(into[c]), _f(out[c]), _f(size[c])
        gain = (_f(into[:, bs] + b[bs]) - f_into[:, bs]).sum(axis=1) + (_f(out[:, as_] + a[as_]) - f_out[:, as_]).sum(axis=1) - 2 * (_f(size + totals[u]) - f_size)
        gain[0] = -np.inf
        c = of_unit[u] = int(np.argmax(gain))
        into[c] += b
        out[c] += a
        size[c] += totals[u]
        f_into[c], f_out[c], f_size[c] = _f(into[c]), _f(out[c]), _f(size[c])
    return of_unit


class Exchange:
    """Class totals of a clustering, and the class in which a word of given contexts gains most."""

    def __init__(self, before: np.ndarray, after: np.ndarray, of_unit: np.ndarray, classes: int) -> None:
        self.into, self.out, self.size = np.zeros((classes, classes)), np.zeros((classes, classes)), np.zeros(classes)
        np.add.at(self.into, of_unit, before)
        np.add.at(self.out, of_unit, after)
        np.add.at(self.size, of_unit, before.sum(axis=1))
        self.f_into, self.f_out, self.f_size = _f(self.into), _f(self.out), _f(self.size)

    def best(self, before: np.ndarray, after: np.ndarray, own: int) -> int:
        """For counts of the classes before and after a word, which is taken out of its class ``own`` first; the first of equals."""
        total, gain = before.sum(), 0.0
        for counts, table, f_table in ((before, self.into, self.f_into), (after, self.out, self.f_out)):
            at = np.flatnonzero(counts)
            gains = _f(table[:, at] + counts[at]) - f_table[:, at]
            gains[own] = f_table[own, at] - _f(table[own, at] - counts[at])
            gain = gain + gains.sum(axis=1)
        sizes = _f(self.size + total) - self.f_size
        sizes[own] = self.f_size[own] - _f(self.size[own] - total)
        gain = gain - 2 * sizes
        gain[0] = -np.inf
        return int(np.argmax(gain))


    def best_many(self, word: np.ndarray, before: np.ndarray, after: np.ndarray, own: np.ndarray) -> np.ndarray:
        """``best`` for many words: ``word``, ``before`` and ``after`` have one entry per occurrence, ``own`` one per word."""
        k = len(self.size)
        gain = np.zeros((len(own), k))
        total = np.bincount(word, minlength=len(own)).astype(float)
        for side, table, f_table in ((before, self.into, self.f_into), (after, self.out, self.f_out)):
            cells, x = np.unique(word * k + side, return_counts=True)
            w, c, x = cells // k, cells % k, x.astype(float)
            gains = _f(table[:, c].T + x[:, None]) - f_table[:, c].T
            mine = own[w]
            gains[np.arange(len(w)), mine] = f_table[mine, c] - _f(table[mine, c] - x)
            starts = np.flatnonzero(np.r_[True, w[1:] != w[:-1]])
            gain[w[starts]] += np.add.reduceat(gains, starts)
        sizes = _f(self.size + total[:, None]) - self.f_size
        at = np.arange(len(own))
        sizes[at, own] = self.f_size[own] - _f(self.size[own] - total)
        gain -= 2 * sizes
        gain[:, 0] = -np.inf
        return np.argmax(gain, axis=1)


def cluster_listed(ids: DataFrame, model: Model, chosen: Exchange, of_ids: np.ndarray) -> np.ndarray:
    """``of_ids`` with the best class for each listed word that has no unit of its own."""
    first, last, classes = 1 + model.clustered, 1 + model.n_words, model.classes
    if first >= last:
        return of_ids

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[bytearray, bytearray]] = {}
        for b in batches:
            at = np.concatenate([[0], np.frombuffer(b"".join(b.column(0).to_pylist()), dtype=np.uint16)]).astype(np.int64)
            own = of_ids[at].astype(np.uint8)
            places = np.flatnonzero((at >= first) & (at < last))  # every text ends with an end, so neighbours are of the same text
            for word, left, right in zip(at[places].tolist(), own[places - 1].tolist(), own[places + 1].tolist(), strict=True):
                pair = held.get(word)
                if pair is None:
                    pair = held[word] = (bytearray(), bytearray())
                pair[0].append(left)
                pair[1].append(right)
        columns = ([pa.array(list(held), pa.int32())], *([pa.array([bytes(p[i]) for p in held.values()], pa.binary())] for i in (0, 1)))
        yield pa.RecordBatch.from_arrays([c[0] for c in columns], names=["id", "before", "after"])

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, int]] = []
        now, before, after = None, np.zeros(0), np.zeros(0)

        def close() -> None:
            if now is not None:
                out.append((now, chosen.best(before, after, int(of_ids[now]))))

        for b in batches:
            for word, left, right in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if word != now:
                    close()
                    now, before, after = word, np.zeros(classes), np.zeros(classes)
                before += np.bincount(np.frombuffer(left, dtype=np.uint8), minlength=classes)
                after += np.bincount(np.frombuffer(right, dtype=np.uint8), minlength=classes)
        close()
        yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int32()), pa.array([o[1] for o in out], pa.int32())], names=["id", "class"])

    sent = ids.where(~F.col("held_out")).select("ids").mapInArrow(contexts, "id int, before binary, after binary")
    found = sent.repartition("id").sortWithinPartitions("id").mapInArrow(choose, "id int, class int").collect()  # FREQUENT rows at most
    of_ids = of_ids.copy()
    for r in found:
        of_ids[r["id"]] = r["class"]
    return of_ids


def cluster_others(ids: DataFrame, model: Model, chosen: Exchange, of_ids: np.ndarray) -> DataFrame:
    """(row, held_out, links, logs, known, class, kinds): the occurrences of all words that are not listed, with their classes.

    In contexts, a neighbour that isn't listed either (256 and more) counts with the class of its suffix.

    Rows of texts hold, for each such word in order, its class and those of its neighbours (``REST`` for one that isn't listed), one byte each; the sum of log10(count + 1/2), and
    how many are known.  Rows without a text say how many distinct training words (``kinds``) have a class.
    """
    listed = 1 + model.n_words

    def occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(row, tag, word); a tag holds the place in the batch, the classes before and after, with a ninth bit for unlisted words, and whether the text is held out."""
        own = np.where(np.arange(len(of_ids)) < listed, of_ids, of_ids + 256)
        for b in batches:
            lengths = [len(x) // 2 for x in b.column(2).to_pylist()]
            at = np.concatenate([[0], np.frombuffer(b"".join(b.column(2).to_pylist()), dtype=np.uint16)]).astype(np.int64)
            places = np.flatnonzero(at >= listed)
            around = own[at]
            text = np.repeat(np.arange(b.num_rows), lengths)[places - 1]
            words = b" ".join(x for x in b.column(3).to_pylist() if x).split(b" ") if len(places) else []
            held_out = b.column(1).to_numpy(zero_copy_only=False).astype(np.int64)[text]
            tag = places << 32 | around[places - 1] << 16 | around[places + 1] << 4 | held_out
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(text)), pa.array(tag), pa.array(words, pa.binary())], names=["row", "tag", "word"])

    def named(b: pa.RecordBatch, kinds: np.ndarray) -> pa.RecordBatch:
        """(row, tag, n) for whole groups of words; now a tag holds the place, the class and those of the neighbours."""
        tag, word = b.column(1).to_numpy(), b.column(2)
        new = np.ones(b.num_rows, dtype=bool)
        if b.num_rows > 1:
            new[1:] = pc.not_equal(word.slice(1), word.slice(0, b.num_rows - 1)).to_numpy(zero_copy_only=False)
        starts = np.flatnonzero(new)
        group = np.cumsum(new) - 1
        left, right, training = tag >> 16 & 0x1FF, tag >> 4 & 0x1FF, tag & 1 == 0
        n = np.bincount(group[training], minlength=len(starts))
        own = np.array([model.of_suffix(w) for w in word.take(pa.array(starts)).to_pylist()], dtype=np.int64)
        often = np.flatnonzero(n >= LEAST)
        if len(often):
            number = np.full(len(starts), -1)
            number[often] = np.arange(len(often))
            used = training & (number[group] >= 0)
            own[often] = chosen.best_many(number[group[used]], left[used] % 256, right[used] % 256, own[often])
        kinds += np.bincount(own[n > 0], minlength=len(kinds))
        out = tag >> 32 << 32 | own[group] << 24 | np.minimum(left, REST) << 16 | np.minimum(right, REST) << 8 | tag & 1
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(out), pa.array(n[group])], names=["row", "tag", "n"])

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The last word of a batch may go on in the next and is carried over; it occurs less often than any listed word."""
        kinds = np.zeros(model.classes, dtype=np.int64)
        carried: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            words = pa.Table.from_batches([*carried, b]).combine_chunks()
            last = pc.equal(words["word"], words["word"][-1]).to_numpy(zero_copy_only=False)
            first = int(np.argmax(last))  # rows are sorted by word
            for part in words.slice(0, first).combine_chunks().to_batches():
                yield named(part, kinds)
            carried = words.slice(first).combine_chunks().to_batches()
        for part in carried:
            yield named(part, kinds)
        at = np.flatnonzero(kinds)
        yield pa.RecordBatch.from_arrays([pa.array([None] * len(at), pa.int64()), pa.array(at), pa.array(kinds[at])], names=["row", "tag", "n"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row per text: occurrences in order."""
        names = ["row", "held_out", "links", "logs", "known", "class", "kinds"]
        types = (pa.int64(), pa.bool_(), pa.binary(), pa.float64(), pa.int64(), pa.int32(), pa.int64())

        def texts(t: pa.Table) -> pa.RecordBatch:
            row, tag, n = (t[c].to_numpy() for c in ("row", "tag", "n"))
            links = np.stack([tag >> s & 0xFF for s in (24, 16, 8)], axis=1).astype(np.uint8)
            starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
            ends = np.append(starts[1:], len(row))
            logs, known = np.add.reduceat(np.log10(n + 0.5), starts), np.add.reduceat((n > 0).astype(np.int64), starts)
            packed = [links[s:e].tobytes() for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]
            none = [None] * len(starts)
            columns = (row[starts], tag[starts] & 1 == 1, packed, logs, known, none, none)
            return pa.RecordBatch.from_arrays([pa.array(c, ty) for c, ty in zip(columns, types, strict=True)], names=names)

        carried: list[pa.RecordBatch] = []
        for b in batches:
            counts = b.filter(pc.is_null(b.column(0)))
            if counts.num_rows:
                none = [None] * counts.num_rows
                columns = (none, none, none, none, none, counts.column(1).to_pylist(), counts.column(2).to_pylist())
                yield pa.RecordBatch.from_arrays([pa.array(c, ty) for c, ty in zip(columns, types, strict=True)], names=names)
            b = b.filter(pc.is_valid(b.column(0)))
            if not b.num_rows:
                continue
            whole = pa.Table.from_batches([*carried, b]).combine_chunks()
            row = whole["row"].to_numpy()
            first = int(np.searchsorted(row, row[-1]))
            if first:
                yield texts(whole.slice(0, first))
            carried = whole.slice(first).combine_chunks().to_batches()
        if carried:
            yield texts(pa.Table.from_batches(carried))

    spread = ids.select("row", "held_out", "ids", "rest").mapInArrow(occurrences, "row bigint, tag bigint, word binary")
    met = spread.repartition("word").sortWithinPartitions("word").mapInArrow(name, "row bigint, tag bigint, n bigint")
    ordered = met.repartition("row").sortWithinPartitions("row", "tag")
    return staged(ordered.mapInArrow(gather, "row bigint, held_out boolean, links binary, logs double, known bigint, class int, kinds bigint"), "brown-others")


def link_pairs(links: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(classes, from, to): the classes of a text's unlisted words, and all transitions into or out of one of them."""
    c, left, right = np.frombuffer(links, dtype=np.uint8).reshape(-1, 3).T.astype(np.int64)
    enters = left != REST  # where the word before isn't listed, that word has the transition
    after = np.where(right == REST, np.append(c[1:], 0), right)
    return c, np.concatenate([left[enters], c]), np.concatenate([c[enters], after])


def transitions(ids: DataFrame, others: DataFrame, model: Model, of_ids: np.ndarray) -> np.ndarray:
    """How often each class follows each, over all training texts."""
    k, listed = model.classes, 1 + model.n_words

    def between_listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        moves = np.zeros(k * k, dtype=np.int64)
        for b in batches:
            at = np.concatenate([[0], np.frombuffer(b"".join(b.column(0).to_pylist()), dtype=np.uint16)]).astype(np.int64)
            both = (at[:-1] < listed) & (at[1:] < listed)
            moves += np.bincount(of_ids[at[:-1][both]] * k + of_ids[at[1:][both]], minlength=k * k)
        yield pa.RecordBatch.from_arrays([pa.array([moves.tobytes()], pa.binary())], names=["moves"])

    def with_others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        moves = np.zeros(k * k, dtype=np.int64)
        for b in batches:
            for raw in b.column(0).to_pylist():
                _, one, other = link_pairs(raw)
                moves += np.bincount(one * k + other, minlength=k * k)
        yield pa.RecordBatch.from_arrays([pa.array([moves.tobytes()], pa.binary())], names=["moves"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        moves = np.zeros(k * k, dtype=np.int64)
        for b in batches:
            for raw in b.column(0).to_pylist():
                moves += np.frombuffer(raw, dtype=np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([moves.tobytes()], pa.binary())], names=["moves"])

    training = F.col("held_out").eqNullSafe(F.lit(False))
    found = ids.where(training).select("ids").mapInArrow(between_listed, "moves binary")
    found = found.union(others.where(training).select("links").mapInArrow(with_others, "moves binary"))
    # tables of one task each are added up in a few tasks before the driver adds the rest
    sums = found.repartition(8).mapInArrow(add, "moves binary").collect()
    return sum((np.frombuffer(r["moves"], dtype=np.int64) for r in sums), np.zeros(k * k, dtype=np.int64)).reshape(k, k).astype(float)


@dataclass
class Fitted:
    """Texts as ids, occurrences of unlisted words, classes, and counts of the training texts: texts, tokens and distinct tokens (ends included)."""

    model: Model
    ids: DataFrame
    others: DataFrame
    of_ids: np.ndarray
    ends: int
    total: int
    distinct: int


def fit(docs: DataFrame, text: str = "text", classes: int | None = None, rounds: int = ROUNDS) -> Fitted:
    training = docs.where(id_fold(F.col("doc_id"), 5) != 1)
    counts = staged(count_words(training.select(F.col(text).cast("binary").alias("raw"))), "brown-counts")
    ends = training.count()
    facts = counts.agg(F.count("*").alias("v"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    total, distinct = facts["n"] + ends, facts["v"] + (ends > 0)
    classes = number_of_classes(distinct) if classes is None else classes
    top = sorted(((bytes(r["word"]), r["n"]) for r in frequent_words(counts).collect()), key=lambda x: (-x[1], x[0]))
    model = Model([w for w, _ in top], [n for _, n in top], classes)
    ids = stage_ids(docs, model, text)
    around = neighbours(ids, model)
    for _ in range(rounds):
        model.of_unit = exchange(*around, model.of_unit, classes)
        around = neighbours(ids, model)
    chosen = Exchange(*around, model.of_unit, classes)
    of_ids = cluster_listed(ids, model, chosen, model.of_ids())
    others = cluster_others(ids, model, chosen, of_ids)
    return Fitted(model, ids, others, of_ids, ends, total, distinct)


def score_documents(docs: DataFrame, text: str = "text", classes: int | None = None, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), log10 probabilities, for every row of ``docs``.

    Texts with crc32(doc_id) mod 5 = 1 are held out of all counts.  Null and empty texts are the end alone.  A null id counts as the empty text.
    Repeated rows are scored, and counted, each.  Without training texts every count is zero.  Extra columns are ignored.
    """
    fitted = fit(docs, text, classes, rounds)
    model, ids, others, of_ids, ends, total, distinct = (getattr(fitted, f.name) for f in fields(Fitted))
    classes = model.classes
    moves = transitions(ids, others, model, of_ids)
    class_size = moves.sum(axis=0)
    share = (class_size + 0.5) / (class_size.sum() + 0.5 * classes)
    log_move = np.log10((moves + PULL * share) / (moves.sum(axis=1, keepdims=True) + PULL))
    class_kinds = np.bincount(of_ids[1 : 1 + model.n_words], minlength=classes).astype(float)
    for r in others.where("row IS NULL").groupBy("class").agg(F.sum("kinds").alias("n")).collect():  # one row per class
        class_kinds[r["class"]] += r["n"]
    log_room = np.log10(class_size + 0.5 * (class_kinds + 1))
    log_room[0] = 0.0  # the end is the one token of its class
    log_count = np.concatenate([[0.0], model.log_counts])
    listed, log_end, all_room = 1 + model.n_words, float(np.log10(ends + 0.5)), float(np.log10(total + 0.5 * (distinct + 1)))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What listed words give: tokens, known ones, log counts, and transitions among them with their emissions."""
        for b in batches:
            sums = []
            for packed in b.column(3).to_pylist():
                i = np.frombuffer(packed, dtype=np.uint16).astype(np.int64)
                before = np.concatenate([[0], i[:-1]])
                own, both = i[i < listed], (i < listed) & (before < listed)
                model_sum = float(log_move[of_ids[before[both]], of_ids[i[both]]].sum() - log_room[of_ids[own]].sum())
                sums.append((len(i), int(np.count_nonzero(own)), float(log_count[own].sum()), model_sum))
            n, k, s, m = (pa.array(x) for x in zip(*sums, strict=True)) if sums else (pa.array([], t) for t in (pa.int64(), pa.int64(), pa.float64(), pa.float64()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), n, k, s, m], names=["row", "doc_id", "held_out", "n", "k", "s", "m"])

    def score_others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sums = []
            for raw in b.column(1).to_pylist():
                c, one, other = link_pairs(raw)
                sums.append(float(log_move[one, other].sum() - log_room[c].sum()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), b.column(3), pa.array(sums, pa.float64())], names=["row", "s_rest", "k_rest", "m_rest"])

    scored = ids.select("row", "doc_id", "held_out", "ids").mapInArrow(score, "row bigint, doc_id bigint, held_out boolean, n bigint, k bigint, s double, m double")
    found = others.where("row IS NOT NULL").select("row", "links", "logs", "known").mapInArrow(score_others, "row bigint, s_rest double, k_rest bigint, m_rest double")
    joined = scored.join(found, "row", "left")
    emitted = F.col("s") + F.coalesce("s_rest", F.lit(0.0))
    return joined.select(
        "doc_id", "held_out", F.col("n").alias("n_tokens"),
        (F.col("k") + F.coalesce("k_rest", F.lit(0)) + (1 if ends else 0)).alias("n_known"),
        F.lit(total).cast("bigint").alias("train_tokens"),
        (emitted + log_end - F.col("n") * all_room).alias("base_score"),
        (emitted + F.col("m") + F.coalesce("m_rest", F.lit(0.0))).alias("score"),
    )
