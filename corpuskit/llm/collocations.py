"""Phrase collocations from a weighted de Bruijn graph of words.

An edge is a phrase of three words, its weight the number of its occurrences; it leads from the node of its first two words to the node of its last two.
Only edges and what ends a piece (its last two words, its last word) are counted in the texts.  All shorter counts follow from the flow through the graph: a node
is left by one of its edges or ends a piece, so the count of two words is the sum of their outgoing edges plus the pieces that they end, and the count of a
word is the sum of the nodes it begins plus the pieces that it ends.

Tasks send a node with all its edges and its count as one row.  Rows meet by node, sorted, and are merged as they come, so that edges, nodes and shares of words leave in one pass;
counts are summed up in numpy, and edges are only looked into where a node reaches the least count.  Nodes that hold
more than ``HEAVY`` of all occurrences in a sample of the texts are dealt by the edge as well; which ones these are changes no result.

Edges and nodes below the least count only feed these sums.  In the graph of the others, unary paths (chains of nodes with one edge in and one out) are
compacted by pointer doubling: each edge learns the first edge of its path and its place.  One node in ``CUT`` (by hash) ends a path whatever its degree, so
paths stay short and circles are cut; an edge that still has no end after ``ROUNDS`` doublings is a path of its own.  How paths are cut changes no
result.  Nodes inside a path are compared with their two edges in place; only path ends are looked up by key.
"""

from __future__ import annotations

import gc
import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuskit.session import staged

LEAST = 10
SHARE = 50  # per cent of a phrase's occurrences that a longer candidate must hold to replace it
SHOWN = 2000
SCALE = 1_000_000
FLUSH = 1_800_000
SENT = 20_000
LISTED = 8  # longer lists of a task's edges are counted before they are sent
HEAVY = 0.002
SAMPLE = 1 / 32
SLICES = 64
CUT = 8
ROUNDS = 7

_PIECE_END = re.compile(rb"[.,;:!?\x0A-\x0D]+")


def _pieces(raw: bytes | None) -> Iterator[list[bytes]]:
    for piece in _PIECE_END.split((raw or b"").lower()):
        words = piece.split()
        if words:
            yield words


def _texts(docs: DataFrame, text: str, lang: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).cast("binary").alias("raw"))


def heavy_nodes(docs: DataFrame, text: str, lang: str) -> dict[str, set[bytes]]:
    """Nodes with more than ``HEAVY`` of all word pairs in the sample, by language: 1 / ``HEAVY`` at most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs: dict[tuple[str, bytes], int] = defaultdict(int)
        total = 0
        for b in batches:
            for name, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for words in _pieces(raw):
                    total += len(words) - 1
                    for pair in map(b" ".join, zip(words, words[1:], strict=False)):
                        pairs[name, pair] += 1
        often = [(*k, n) for k, n in pairs.items() if n > HEAVY / 4 * total]  # a node that is heavy in all is so in some task
        rows = [*often, (None, None, total)]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.binary(), pa.int64()), strict=True)], names=["lang", "head", "n"])

    found = _texts(docs.sample(SAMPLE, 7), text, lang).mapInArrow(count, "lang string, head binary, n bigint").groupBy("lang", "head").agg(F.sum("n").alias("n")).collect()
    total = sum(r["n"] for r in found if r["head"] is None)
    heavy: dict[str, set[bytes]] = {}
    for r in found:
        if r["head"] is not None and r["n"] > HEAVY * total:
            heavy.setdefault(r["lang"], set()).add(bytes(r["head"]))
    return heavy


def packed_edges(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """(node, n, tails): a node, its count and the words that follow it in a task's texts, parted by blanks, some with their counts.

    ``node`` is the two words, a slice (0 but for heavy nodes) and the language, parted by tabs: one column to deal and sort by.  An empty tail is the end of a piece; a node of one
    word is the last word of a piece.
    """
    heavy = heavy_nodes(docs, text, lang)
    types = (pa.binary(), pa.int64(), pa.binary())

    def packed(tails: list[bytes]) -> bytes:
        if len(tails) > LISTED:
            tails = [t if n == 1 else b"%b\t%d" % (t, n) for t, n in Counter(tails).items()]
        return b" ".join(tails)

    def rows(held: dict[str, dict[bytes, list[bytes]]]) -> Iterator[pa.RecordBatch]:
        for name, nodes in held.items():
            own = name.encode()
            sliced: dict[bytes, list[bytes]] = defaultdict(list)
            for head in heavy.get(name, set()) & nodes.keys():
                for tail in nodes.pop(head):
                    sliced[b"%b\t%d\t%b" % (head, 1 + zlib.crc32(tail) % SLICES, own)].append(tail)
            # taken out a part at a time, so that what is sent is not held twice
            for left, end in ((sliced, b""), (nodes, b"\t0\t" + own)):
                while left:
                    taken = [left.popitem() for _ in range(min(SENT, len(left)))]
                    columns = [head + end for head, _ in taken], [len(x) for _, x in taken], [x[0] if len(x) == 1 else packed(x) for _, x in taken]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["node", "n", "tails"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, dict[bytes, list[bytes]]] = {}
        size = 0
        gc.disable()  # a million lists without a cycle: collecting them again and again takes a fifth of the time
        for b in batches:
            for name, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                nodes = held.get(name)
                if nodes is None:
                    nodes = held[name] = defaultdict(list)
                for words in _pieces(raw):
                    after = words[2:]
                    after.append(b"")
                    for head, tail in zip(map(b" ".join, zip(words, words[1:], strict=False)), after, strict=False):
                        nodes[head].append(tail)
                    nodes[words[-1]].append(b"")
                    size += len(words)
                if size >= FLUSH:
                    yield from rows(held)
                    held, size = {}, 0
        yield from rows(held)
        gc.enable()

    return _texts(docs, text, lang).mapInArrow(count, "node binary, n bigint, tails binary")


def merge_edges(packed: DataFrame, least: int) -> DataFrame:
    """(size, lang, gram, n): edges (size 3) of the least count or more, nodes (2) of it or of heavy ones a share, and shares of all words (1)."""
    names = ["size", "lang", "gram", "n"]

    def strong(tails: list[bytes]) -> list[tuple[bytes, int]]:
        counts: dict[bytes, int] = defaultdict(int)
        for listed in tails:
            for entry in listed.split(b" "):
                tail, counted, n = entry.partition(b"\t")
                counts[tail] += int(n) if counted else 1
        return [(tail, n) for tail, n in counts.items() if n >= least and tail]

    def runs(*columns: pa.Array) -> np.ndarray:
        """Where a new combination of values begins."""
        n = len(columns[0])
        new = np.zeros(n, dtype=bool)
        new[:1] = True
        for c in columns:
            new[1:] |= pc.not_equal(c.slice(1), c.slice(0, n - 1)).to_numpy(zero_copy_only=False) if n > 1 else False
        return np.flatnonzero(new)

    def merged(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        """Whole nodes only."""
        node, n, tails = b.columns
        parts = pc.split_pattern(node.cast(pa.string()), "\t", max_splits=2)
        head, part, lang = (pc.list_element(parts, i) for i in range(3))
        flows = n.to_numpy()
        starts = runs(node)
        sums = np.add.reduceat(flows, starts) if len(starts) else flows[:0]
        ends = np.append(starts[1:], b.num_rows)
        word = pc.list_element(pc.split_pattern(head, " ", max_splits=1), 0)
        words = runs(lang, word)
        if len(words):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(words), 1, np.int32)), lang.take(pa.array(words)), word.take(pa.array(words)), pa.array(np.add.reduceat(flows, words))], names=names)
        two = pc.match_substring(head, " ").to_numpy(zero_copy_only=False)[starts]
        sliced = pc.not_equal(part, "0").to_numpy(zero_copy_only=False)[starts]
        at = np.flatnonzero(two & ((sums >= least) | sliced))
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), 2, np.int32)), lang.take(pa.array(starts[at])), head.take(pa.array(starts[at])), pa.array(sums[at])], names=names)
        out = []
        for i in at[sums[at] >= least].tolist():
            first = head[int(starts[i])].as_py()
            found = strong(tails.slice(starts[i], ends[i] - starts[i]).to_pylist())
            out += [(3, lang[int(starts[i])].as_py(), f"{first} {tail.decode()}", k) for tail, k in found]
        columns = zip(*out, strict=True) if out else [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.string(), pa.string(), pa.int64()), strict=True)], names=names)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The last node of a batch may go on in the next: it is carried over."""
        carried: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            begun = int(runs(b.column(0))[-1])
            goes_on = bool(carried) and carried[-1].column(0)[0].equals(b.column(0)[0])
            if carried and (begun > 0 or not goes_on):
                upto = begun if goes_on else 0
                whole = pa.Table.from_batches([*carried, b.slice(0, upto)]).combine_chunks().to_batches()
                for w in whole:
                    yield from merged(w)
                carried, b, begun = [], b.slice(upto), begun - upto
            if begun > 0:
                yield from merged(b.slice(0, begun))
                b = b.slice(begun)
            carried.append(b)
        if carried:
            for w in pa.Table.from_batches(carried).combine_chunks().to_batches():
                yield from merged(w)

    dealt = packed.repartition("node").sortWithinPartitions("node")
    return dealt.mapInArrow(merge, "size int, lang string, gram string, n bigint")


def _first(gram: str, words: int) -> Column:
    """The first words of a gram."""
    return F.substring_index(gram, " ", words)


class Graph:
    """``edges`` (lang, gram, n) and ``nodes`` (lang, node, n) of the least count or more, ``words`` (lang, word, n) and ``totals`` (lang, total) of all."""

    def __init__(self, docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST) -> None:
        counted = staged(merge_edges(packed_edges(docs, text, lang), least), "phrase-graph")

        def summed(size: int, name: str) -> DataFrame:
            return counted.where(F.col("size") == size).groupBy("lang", F.col("gram").alias(name)).agg(F.sum("n").alias("n"))

        self.words = staged(summed(1, "word"), "phrase-words")
        self.totals = self.words.groupBy("lang").agg(F.sum("n").alias("total"))
        self.edges = counted.where("size = 3").select("lang", "gram", "n")
        self.nodes = staged(summed(2, "node").where(F.col("n") >= least), "phrase-nodes")


def _last_two(gram: str) -> Column:
    return F.substring_index(gram, " ", -2)


def unary_links(edges: DataFrame) -> DataFrame:
    """(lang, gram, ahead): the one edge before each edge that begins in a node with one edge in and one out, but for the nodes that cut paths."""
    out = edges.groupBy("lang", _first("gram", 2).alias("node")).agg(F.count("*").alias("n_out"), F.max("gram").alias("gram"))
    into = edges.groupBy("lang", _last_two("gram").alias("node")).agg(F.count("*").alias("n_in"), F.max("gram").alias("ahead"))
    inner = (F.col("n_in") == 1) & (F.col("n_out") == 1) & (F.pmod(F.xxhash64("node"), F.lit(CUT)) != 0)
    return out.join(into, ["lang", "node"]).where(inner).select("lang", "gram", "ahead")


def compact_paths(edges: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(lang, root, edges): every unary path as the sorted array of its edges (place, gram, n, head_n, tail_n); ``edges`` carries the last two too."""
    known = staged(unary_links(edges).select("lang", "gram", "ahead", F.lit(1).alias("place")), "phrase-links")
    for _ in range(rounds):
        further = known.select("lang", F.col("gram").alias("ahead"), F.col("ahead").alias("far"), F.col("place").alias("more"))
        moved = known.join(further, ["lang", "ahead"], "left")
        known = staged(
            moved.select("lang", "gram", F.coalesce("far", "ahead").alias("ahead"), (F.col("place") + F.coalesce("more", F.lit(0))).alias("place"), F.col("far").isNotNull().alias("open")),
            "phrase-links",
        )
        if known.where("open").isEmpty():
            break
    ends = known.join(known.select("lang", F.col("gram").alias("ahead")), ["lang", "ahead"], "left_anti")  # what still has an edge ahead stands for itself
    placed = edges.join(ends.select("lang", "gram", "ahead", "place"), ["lang", "gram"], "left")
    entry = F.struct(F.coalesce("place", F.lit(0)).alias("place"), "gram", "n", "head_n", "tail_n")
    return placed.groupBy("lang", F.coalesce("ahead", "gram").alias("root")).agg(F.array_sort(F.collect_list(entry)).alias("edges"))


def path_phrases(paths: DataFrame) -> DataFrame:
    """(lang, phrase, n_words, least, most): the words along each path and the smallest and largest weight of its edges."""
    tails = F.transform("edges", lambda e: F.substring_index(e["gram"], " ", -1))
    weights = F.transform("edges", lambda e: e["n"])
    phrase = F.concat_ws(" ", F.substring_index(F.col("edges")[0]["gram"], " ", 2), tails)
    return paths.select("lang", phrase.alias("phrase"), (F.size("edges") + 2).alias("n_words"), F.array_min(weights).alias("least"), F.array_max(weights).alias("most"))


def covered_nodes(paths: DataFrame) -> DataFrame:
    """(lang, node, most): the largest weight of an edge at each node.  Nodes inside a path see both their edges there and are one row."""
    first = F.struct(F.substring_index(F.col("edges")[0]["gram"], " ", 2).alias("node"), F.col("edges")[0]["n"].alias("n"))
    rest = F.transform(
        "edges",
        lambda e, i: F.struct(F.substring_index(e["gram"], " ", -2).alias("node"), F.greatest(e["n"], F.coalesce(F.get("edges", i + 1)["n"], F.lit(0))).alias("n")),
    )
    return paths.select("lang", F.inline(F.concat(F.array(first), rest))).groupBy("lang", "node").agg(F.max("n").alias("most"))


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, shown: int = SHOWN) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the best ``shown`` phrases of two or three words of each language.

    ``a`` counts the phrase, ``l`` and ``r`` the parts of its worst cut, ``n`` all words of the language; the score is floor(1,000,000 a a / (l r)), exact.
    Phrases that a longer candidate holds with at least half their occurrences are left out.  Ties go by count, then by the bytes of the phrase.  Null texts
    are empty, a null language is ``und``.  Repeated rows and null ids count each.  Other columns are ignored; an empty table gives no rows.
    """
    graph = Graph(docs, text, lang, least)
    head = graph.nodes.select("lang", F.col("node").alias("head"), F.col("n").alias("head_n"))
    tail = graph.nodes.select("lang", F.col("node").alias("tail"), F.col("n").alias("tail_n"))
    edges = graph.edges.withColumns({"head": _first("gram", 2), "tail": _last_two("gram")}).join(head, ["lang", "head"]).join(tail, ["lang", "tail"])
    edges = staged(edges.select("lang", "gram", "n", "head_n", "tail_n"), "phrase-edges")
    paths = staged(compact_paths(edges), "phrase-paths")

    three = paths.select("lang", F.inline("edges")).select("lang", F.col("gram").alias("phrase"), F.col("n").alias("a"), "head_n", "tail_n")
    free = graph.nodes.join(covered_nodes(paths), ["lang", "node"], "left").where("most IS NULL OR 100 * most < {} * n".format(SHARE))
    nothing = F.lit(None).cast("bigint")
    two = free.select("lang", F.col("node").alias("phrase"), F.col("n").alias("a"), nothing.alias("head_n"), nothing.alias("tail_n"))
    words = graph.words.where(F.col("n") >= least)
    begins = words.select("lang", F.col("word").alias("begin"), F.col("n").alias("begin_n"))
    ends = words.select("lang", F.col("word").alias("end"), F.col("n").alias("end_n"))
    both = three.union(two).withColumns({"begin": _first("phrase", 1), "end": F.substring_index("phrase", " ", -1)})
    both = both.join(begins, ["lang", "begin"]).join(ends, ["lang", "end"])

    def cut(k: int, left: Column, right: Column) -> Column:
        score = F.expr(f"(CAST({SCALE} AS decimal(38, 0)) * a * a)").cast("decimal(38,0)")
        return F.struct(F.call_function("div", score, left.cast("decimal(19,0)") * right).alias("score"), F.lit(k).alias("k"), left.alias("l"), right.alias("r"))

    first_cut = cut(1, F.col("begin_n"), F.coalesce("tail_n", "end_n"))
    second_cut = F.when(F.col("head_n").isNotNull(), cut(2, F.coalesce("head_n", F.lit(1)), F.col("end_n")))
    scored = both.select("lang", "phrase", "a", F.least(first_cut, second_cut).alias("cut")).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))).where(F.col("rank") <= shown)
    return ranked.join(graph.totals, "lang").select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", F.col("total").alias("n"), "score")
