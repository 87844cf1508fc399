"""Near duplicates by 64-bit SimHash fingerprints, compared exactly in tiles.

A fingerprint's population count, and those of its ``bands`` equal parts, bound Hamming distances from below: two fingerprints differ in at least the
sum of the differences of their parts' counts.  Distinct fingerprints are therefore filed in cells by the counts of their parts, and only cells
within the radius are compared.  A tile is one slice of a cell against one slice of all its neighbours; both slices have at most about
``TILE`` fingerprints, so that tasks stay small whatever a cell holds.  Within a tile, exclusive-or and bit counts of numpy compare everything, and only a
spanning forest of the links leaves the task (each linked fingerprint with the least one of its group in the tile), never all pairs of a group.

``near_links`` links by the fingerprints alone, as the query of this operator states it.  ``similar_links``, the rule of the pipeline, takes them
as a filter only, wide enough for the stated similarity, and confirms every link by the exact similarity of the shingle sets.

Work in tiles grows with the square of the number of distinct fingerprints; the finer cells of more bands cut the factor.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuskit.llm.common import arrow_map, fresh, id_filter, text_udf
from corpuskit.llm.components import components
from corpuskit.session import staged

TILE = 16_384
BLOCK = 1024
BANDS = 2
SEED = 42
SIMILAR = 0.8
RADIUS = 22  # bits; at a similarity of 0.8, 9.7 of 64 are expected to differ with a standard deviation of 2.9


def fingerprint(raw: bytes | None, width: int = 4) -> int:
    """Unsigned fingerprint of a whole text: the majority bits of XXH64 over its word shingles, repeats included."""
    words = (raw or b"").lower().split()
    if not words:
        return 0
    if len(words) <= width:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[: -width] + 1)).tolist()
    digest, seed = xxhash.xxh64_intdigest, SEED
    hashes = np.array([digest(joined[s:e], seed) for s, e in zip(starts, ends[width - 1 :].tolist(), strict=True)], dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), 65_536):
        part = hashes[i : i + 65_536]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, text: str = "text", width: int = 4) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed bigint.  Null and empty texts have fingerprint 0."""

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        values = np.array([fingerprint(t, width) for t in batch.column(1).to_pylist()], dtype=np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(values)], names=["doc_id", "fp"])

    return arrow_map(docs.select(F.col("doc_id").cast("bigint"), F.col(text).cast("binary")), make, "doc_id bigint, fp bigint")


def spanning_forest(left: np.ndarray, right: np.ndarray, radius: int, inside: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprint, least linked one) over all links within ``left`` (if ``inside``) and between ``left`` and ``right``, found block by block."""
    every = np.concatenate([left, right])
    parent = np.arange(len(every))
    within = [(left, 0, left, 0)] * inside + [(left, 0, right, len(left))]
    linked = False
    for a, base_a, b, base_b in within:
        for i in range(0, len(a), BLOCK):
            for j in range(i if a is b else 0, len(b), BLOCK):
                near = np.bitwise_count(a[i : i + BLOCK, None] ^ b[None, j : j + BLOCK]) <= radius
                if a is b and i == j:
                    np.fill_diagonal(near, False)
                if near.any():
                    x, y = np.nonzero(near)
                    _join(parent, x + (base_a + i), y + (base_b + j))
                    linked = True
    if not linked:
        return every[:0], every[:0]
    roots = _roots(parent)
    order = np.argsort(every.view(np.int64), kind="stable")
    least = np.full(len(every), -1)
    np.put(least, roots[order][::-1], order[::-1])  # the last put is the least fingerprint of the root
    to = every[least[roots]]
    moved = to != every
    return every[moved], to[moved]


def _roots(parent: np.ndarray) -> np.ndarray:
    while True:
        up = parent[parent]
        if np.array_equal(up, parent):
            return parent
        parent[:] = up


def _join(parent: np.ndarray, x: np.ndarray, y: np.ndarray) -> None:
    """Merge the trees of all pairs (x, y): hook the larger root under the smaller, compress, until nothing moves."""
    while True:
        _roots(parent)
        a, b = parent[x], parent[y]
        open_ = a != b
        if not open_.any():
            return
        x, y, a, b = x[open_], y[open_], a[open_], b[open_]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))


def _offsets(bands: int, radius: int) -> list[tuple[int, ...]]:
    """Count differences a neighbour cell may have: the lexicographically positive half of those whose absolute values add up to the radius at most."""
    steps = [d for d in itertools.product(range(-radius, radius + 1), repeat=bands) if sum(map(abs, d)) <= radius]
    return [d for d in steps if d > (0,) * bands]


def near_links(distinct: DataFrame, radius: int = 4, bands: int = BANDS, tile: int = TILE) -> DataFrame:
    """(a, b): a spanning set of the links between distinct fingerprints (column fp) that differ in at most ``radius`` bits."""
    cuts = [64 * i // bands for i in range(bands + 1)]
    widths = [high - low for low, high in itertools.pairwise(cuts)]
    base = max(widths) + 1
    code = F.lit(0)
    for low, width in zip(cuts, widths, strict=False):
        part = F.shiftrightunsigned("fp", low).bitwiseAND(F.lit((1 << width) - 1 if width < 64 else -1).cast("bigint"))
        code = code * base + F.bit_count(part).cast("int")
    filed = distinct.select("fp", code.alias("cell"))
    sizes = {r["cell"]: r["count"] for r in filed.groupBy("cell").count().collect()}  # at most base ** bands, 10,648 rows

    def split(cell: int) -> tuple[int, ...]:
        return tuple(cell // base**i % base for i in range(bands - 1, -1, -1))

    def joined(parts: tuple[int, ...]) -> int:
        out = 0
        for p in parts:
            out = out * base + p
        return out

    steps = _offsets(bands, radius)

    def neighbours(cell: int) -> list[int]:
        moved = (tuple(x + y for x, y in zip(split(cell), d, strict=True)) for d in steps)
        return [c for p in moved if all(0 <= v <= w for v, w in zip(p, widths, strict=True)) and (c := joined(p)) in sizes]

    plan = []  # (cell, role, anchor cell, slices of this role in the anchor, slices of the other role)
    for cell, size in sizes.items():
        near = neighbours(cell)
        own, others = math.ceil(size / tile), math.ceil((size + sum(sizes[c] for c in near)) / tile)
        plan.append((cell, 0, cell, own, others))
        plan += [(c, 1, cell, others, own) for c in [cell, *near]]
    spark = distinct.sparkSession
    dealt = spark.createDataFrame(plan, "cell int, role int, anchor int, mine int, theirs int").groupBy("cell").agg(F.collect_list(F.struct("role", "anchor", "mine", "theirs")).alias("to"))
    part = F.pmod(F.xxhash64("fp"), F.col("t.mine")).cast("int")
    rows = filed.join(F.broadcast(dealt), "cell").select("fp", F.explode("to").alias("t")).select(
        "fp", "t.role", "t.anchor", part.alias("slice"), F.explode(F.sequence(F.lit(0), F.col("t.theirs") - 1)).alias("other")
    )
    tiles = rows.select("fp", "role", "anchor", F.when(F.col("role") == 0, F.col("slice")).otherwise(F.col("other")).alias("i"), F.when(F.col("role") == 0, F.col("other")).otherwise(F.col("slice")).alias("j"))

    def compare(key: tuple, table: pa.Table) -> pa.Table:
        fp, role = table["fp"].to_numpy().view(np.uint64), table["role"].to_numpy()
        left, right = np.sort(fp[role == 0]), np.sort(fp[role == 1])
        right = right[~np.isin(right, left)]
        a, b = spanning_forest(left, right, radius, inside=key[2].as_py() == 0)
        return pa.table({"a": a.view(np.int64), "b": b.view(np.int64)})

    return tiles.groupBy("anchor", "i", "j").applyInArrow(compare, "a bigint, b bigint")


def near_components(prints: DataFrame, radius: int = 4, bands: int = BANDS, tile: int = TILE) -> DataFrame:
    """(fp, root): every fingerprint of ``prints`` (column fp) with the one that names its component."""
    distinct = staged(prints.select("fp").distinct(), "fingerprints")
    linked = components(near_links(distinct, radius, bands, tile))
    return distinct.join(linked, distinct["fp"] == linked["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"))


def shingles(raw: bytes | None, width: int = 5) -> np.ndarray:
    """Sorted distinct XXH64 of the word shingles of a whole text; a text of fewer words is one shingle, an empty one has none."""
    words = (raw or b"").lower().split()
    if not words:
        return np.zeros(0, dtype="<u8")
    digest, seed = xxhash.xxh64_intdigest, SEED
    joined = b" ".join(words)
    if len(words) <= width:
        return np.array([digest(joined, seed)], dtype="<u8")
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[: -width] + 1)).tolist()
    return np.unique(np.array([digest(joined[s:e], seed) for s, e in zip(starts, ends[width - 1 :].tolist(), strict=True)], dtype="<u8"))


def _majority(hashes: np.ndarray) -> int:
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), 65_536):
        part = hashes[i : i + 65_536]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def _remixed(hashes: np.ndarray) -> np.ndarray:
    """Other 64 bits of each hash (the finalizer of splitmix64), for a fingerprint that is independent of the first."""
    z = hashes + np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def _signed(value: int) -> int:
    """An unsigned 64-bit number as the bigint of the same bits."""
    return value - (1 << 64) if value >> 63 else value


def set_key(hashes: np.ndarray) -> int:
    """Names a set of shingles; 0 is the empty set."""
    return xxhash.xxh64_intdigest(hashes.tobytes(), SEED) if len(hashes) else 0


def set_prints(docs: DataFrame, text: str = "text", width: int = 5) -> DataFrame:
    """(doc_id, key, fp, fp2, n): name of the text's shingle set, two independent SimHash fingerprints of it and its size."""

    def make(raw: bytes | None) -> tuple[int, int, int, int]:
        h = shingles(raw, width)
        return _signed(set_key(h)), _signed(_majority(h)), _signed(_majority(_remixed(h))), len(h)

    made = text_udf(make, "key bigint, fp bigint, fp2 bigint, n bigint")
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), made(F.col(text)).alias("made")).select("doc_id", "made.*")


def _close(a: np.ndarray, b: np.ndarray, radius: int) -> np.ndarray:
    """Index pairs (2, m) of rows (fp, fp2) of ``a`` and ``b`` that differ in at most ``radius`` bits of fp and 2 * radius - 8 of both.

    With 22 and 36 of 128 bits 5 of 20,000 simulated pairs of similarity 0.8 were missed; more similar ones are missed less often.
    """
    bits = np.bitwise_count(a[:, None, 0] ^ b[None, :, 0])
    x, y = np.nonzero(bits <= radius)
    both = bits[x, y] + np.bitwise_count(a[x, 1] ^ b[y, 1]) <= 2 * radius - 8
    return np.stack([x[both], y[both]])


def candidate_groups(prints: np.ndarray, n_left: int, radius: int, inside: bool) -> np.ndarray:
    """Root index of each row (fp, fp2) over the candidate links from the first ``n_left`` rows to the rest and, if ``inside``, among them."""
    parent = np.arange(len(prints))
    for i in range(0, n_left, BLOCK):
        for j in range(i if inside else n_left, len(prints), BLOCK):
            x, y = _close(prints[i : min(i + BLOCK, n_left)], prints[j : j + BLOCK], radius)
            if len(x):
                _join(parent, x + i, y + j)
    return _roots(parent)


def similar_forest(prints: np.ndarray, sets: list[np.ndarray], radius: int, similar: float) -> list[tuple[int, int]]:
    """A spanning forest of the candidate links whose sets have a Jaccard similarity of at least ``similar``, each of them computed exactly."""
    rest, links = np.arange(len(sets)), []
    while len(rest):
        open_, rest = [rest[0]], rest[1:]
        while open_ and len(rest):
            x = open_.pop()
            _, near = _close(prints[[x]], prints[rest], radius)
            found = []
            for k in near.tolist():
                a, b = sets[x], sets[rest[k]]
                shared = len(np.intersect1d(a, b, assume_unique=True))
                if shared >= similar * (len(a) + len(b) - shared):
                    found.append(k)
            links += [(int(x), int(y)) for y in rest[found]]
            open_ += rest[found].tolist()
            rest = np.delete(rest, found)
    return links


def similar_links(docs: DataFrame, prints: DataFrame, text: str, width: int, radius: int, similar: float, tile: int = TILE) -> DataFrame:
    """(a, b): a spanning set of the links between shingle sets that are near by ``_close`` and have Jaccard ``similar`` or more.

    Sets are filed by size: similar sizes differ by the factor 1 / ``similar`` at most, so a class is compared with itself and the next.  As in ``near_links``
    a tile is one slice of a class against one slice of both.  Only sets of candidate groups are made again from their texts, for the exact comparison.
    """
    distinct = staged(prints.where("n > 0").groupBy("key").agg(F.min("doc_id").alias("doc_id"), *[F.first(c).alias(c) for c in ("fp", "fp2", "n")]), "sets")
    filed = distinct.select("key", "fp", "fp2", F.floor(F.log("n") / -math.log(similar) + 1e-9).cast("int").alias("class"), "n")
    # slices of long texts hold fewer sets; at most a few dozen classes
    weight = {r["class"]: max(r["c"], r["s"] / 500) for r in filed.groupBy("class").agg(F.count("*").alias("c"), F.sum("n").alias("s")).collect()}
    plan = []
    for c, w in weight.items():
        own, others = math.ceil(w / tile), math.ceil((w + weight.get(c + 1, 0)) / tile)
        plan += [(c, 0, c, own, others), (c, 1, c, others, own)] + [(c + 1, 1, c, others, own)] * (c + 1 in weight)
    spark = docs.sparkSession
    dealt = spark.createDataFrame(plan, "class int, role int, anchor int, mine int, theirs int").groupBy("class").agg(F.collect_list(F.struct("role", "anchor", "mine", "theirs")).alias("to"))
    part = F.pmod(F.xxhash64("key"), F.col("t.mine")).cast("int")
    rows = filed.join(F.broadcast(dealt), "class").select("key", "fp", "fp2", F.explode("to").alias("t")).select(
        "key", "fp", "fp2", "t.role", "t.anchor", part.alias("slice"), F.explode(F.sequence(F.lit(0), F.col("t.theirs") - 1)).alias("other")
    )
    first = F.col("role") == 0
    tiles = rows.select("key", "fp", "fp2", "role", "anchor", F.when(first, F.col("slice")).otherwise(F.col("other")).alias("i"), F.when(first, F.col("other")).otherwise(F.col("slice")).alias("j"))

    def compare(key: tuple, table: pa.Table) -> pa.Table:
        names, role = table["key"].to_numpy(), table["role"].to_numpy()
        of = np.stack([table["fp"].to_numpy(), table["fp2"].to_numpy()], axis=1).view(np.uint64)
        left = np.flatnonzero(role == 0)
        right = np.flatnonzero(role == 1)
        right = right[~np.isin(names[right], names[left])]
        order = np.concatenate([left, right])
        roots = candidate_groups(of[order], len(left), radius, key[2].as_py() == 0)
        held = np.bincount(roots, minlength=len(order))[roots] > 1
        anchor, i, j = (np.full(int(held.sum()), k.as_py(), dtype=np.int32) for k in key)
        return pa.table({"anchor": anchor, "i": i, "j": j, "root": names[order][roots[held]], "key": names[order][held], "fp": of[order][held, 0].view(np.int64), "fp2": of[order][held, 1].view(np.int64)})

    schema = "anchor int, i int, j int, root bigint, key bigint, fp bigint, fp2 bigint"
    members = staged(tiles.groupBy("anchor", "i", "j").applyInArrow(compare, schema), "candidates")

    def make(raw: bytes | None) -> tuple[int, bytes]:
        h = shingles(raw, width)
        return _signed(set_key(h)), h.tobytes()

    wanted = members.select("key").distinct()
    ids = staged(distinct.join(wanted, "key", "left_semi").select(F.col("doc_id").alias("wanted_id")).distinct(), "wanted")
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(text).cast("binary").alias("raw"))
    texts = texts.where(id_filter(ids)(F.col("doc_id"))).join(ids, F.col("doc_id").eqNullSafe(F.col("wanted_id")), "left_semi")
    made = texts.select(text_udf(make, "key bigint, members binary")(F.col("raw")).alias("made")).select("made.*")
    sets = made.join(wanted, "key", "left_semi").groupBy("key").agg(F.first("members").alias("members"))

    def confirm(table: pa.Table) -> pa.Table:
        names = table["key"].to_numpy()
        of = np.stack([table["fp"].to_numpy(), table["fp2"].to_numpy()], axis=1).view(np.uint64)
        links = similar_forest(of, [np.frombuffer(b, dtype="<u8") for b in table["members"].to_pylist()], radius, similar)
        at = np.array(links, dtype=np.int64).reshape(-1, 2)
        return pa.table({"a": names[at[:, 0]], "b": names[at[:, 1]]})

    return members.join(sets, "key").groupBy("anchor", "i", "j", "root").applyInArrow(confirm, "a bigint, b bigint")


def _grouped(docs: DataFrame, text: str, width: int, radius: int, bands: int, tile: int, similar: float | None) -> DataFrame:
    """(doc_id, key, fp, root) of every row; rows of one root are one component.  The key is the fingerprint, or names the shingle set."""
    if similar is None:
        prints = staged(fingerprints(docs, text, width), "prints")
        roots = near_components(prints, radius, bands, tile)
        return prints.join(roots, "fp").select("doc_id", F.col("fp").alias("key"), "fp", "root")
    prints = staged(set_prints(docs, text, width), "prints")
    linked = components(similar_links(docs, prints, text, width, radius, similar, tile))
    return prints.join(linked, prints["key"] == linked["node"], "left").select("doc_id", "key", "fp", F.coalesce("root", "key").alias("root"))


def group_documents(docs: DataFrame, text: str = "text", width: int = 5, radius: int = RADIUS, bands: int = BANDS, tile: int = TILE, similar: float | None = SIMILAR) -> DataFrame:
    """(doc_id, fp, component_id) for every row of ``docs``; component_id is the least doc_id of the component.

    With ``similar``, documents are linked if their sets of ``width``-word shingles have that Jaccard similarity or more (found by two fingerprints
    of the sets, see ``_close``); without, if the fingerprints of all shingles, repeats included, lie within ``radius`` bits.
    Null and empty texts are alike.  Rows with a null doc_id are linked as others are and take the
    least doc_id of their component, null if there is none.  Repeated rows stay.
    """
    rows = staged(_grouped(docs, text, width, radius, bands, tile, similar), "classes")
    names = rows.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return rows.join(names, "root").select("doc_id", "fp", "component_id")


def keep_one(
    docs: DataFrame, text: str = "text", width: int = 5, radius: int = RADIUS, bands: int = BANDS, tile: int = TILE, similar: float | None = SIMILAR
) -> DataFrame:
    """``docs`` with exactly one row of each component of ``group_documents``: the one with the least doc_id, null last, then the least key.

    Only ids that repeat or are null leave open which row is meant; keys are made again from the texts of just those rows.  Rows whose id belongs to no loser
    and to no open case, by ``id_filter``, stay where they are; texts are exchanged only for the rest.
    """
    grouped = staged(_grouped(docs, text, width, radius, bands, tile, similar), "grouped")
    known, held, won = fresh(docs, "s_keep"), fresh(docs, "s_key"), fresh(docs, "s_won")
    uses = grouped.groupBy(F.col("doc_id").alias("id")).agg((F.col("id").isNull() | (F.count("*") > 1)).alias("open"))
    least = grouped.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("w"))
    winners = least.select(F.col("w.doc_id").alias(known), F.col("w.key").alias(won)).join(uses, F.col(known).eqNullSafe(F.col("id")))
    winners = staged(winners.select(known, won, "open"), "winners")
    won_here = F.col("doc_id").eqNullSafe(F.col("w.doc_id")) & (F.col("key") == F.col("w.key"))
    losers = grouped.join(least, "root").where(~won_here).select("doc_id")
    suspect = id_filter(losers.union(winners.where("open").select(known)))(F.col("doc_id").cast("bigint"))
    sure, docs = docs.where(~suspect), docs.where(suspect)
    plain = docs.join(winners.where("not open").select(known), F.col("doc_id") == F.col(known), "left_semi")

    def key(raw: bytes | None) -> int:
        return _signed(fingerprint(raw, width) if similar is None else set_key(shingles(raw, width)))

    unclear = winners.where("open").select(known, won)
    rows = docs.join(unclear.select(known).distinct(), F.col("doc_id").eqNullSafe(F.col(known)), "left_semi")
    rows = rows.withColumn(held, text_udf(key, "bigint")(F.col(text)))
    rows = rows.join(unclear, F.col("doc_id").eqNullSafe(F.col(known)) & (F.col(held) == F.col(won)), "left_semi")
    return sure.unionByName(plain).unionByName(rows.dropDuplicates(["doc_id", held]).drop(held))
