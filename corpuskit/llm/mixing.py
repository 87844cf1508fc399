"""Mixing sources to target weights by systematic sampling.

Targets are shares of all words: sources weigh ``WEIGHTS`` in turn, no source gives more than ``MOST`` times its words, and what it can't give is
shared by weight among the others.  With sources sorted by how soon they reach their limit, the limited ones are a prefix, so targets follow from
two running sums over the table of sources.

Within a source every document is expected ``target / words`` times.  Documents stand in the order of their size (and, for equal sizes, of a hash
of their id), their expected copies are summed up along that order from one random offset per source, and a document is emitted once per integer crossed.
Ordering by size makes each size class give its share, so that the words taken stay near the target; of ``DRAWS`` random offsets, the one that comes
nearest is used.  The running sum is the row number times
the expectation: rows are numbered in buckets of (source, size class, hash), whose counts are summed up per source first.  A source has at most
256 times about 1,500 buckets, whatever its number of documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuskit.llm.common import n_words, prefix
from corpuskit.session import staged

WEIGHTS = (5, 2, 1)
MOST = 3
DRAWS = 32


def source_targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size, target, source_no) from (source, source_size); sources in order of code points, null last."""
    everything = Window.partitionBy(F.lit(0))
    numbered = sizes.withColumn("source_no", F.row_number().over(everything.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), (F.col("source_no") % len(WEIGHTS) + 1).cast("int"))
    limits = numbered.withColumn("weight", weight).withColumn("most", MOST * F.col("source_size").cast("double"))
    order = everything.orderBy(F.col("most") / F.col("weight"), "source_no")
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    shares = limits.withColumns(
        {
            "left": F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(before), F.lit(0.0)),
            "weights": F.sum("weight").over(after),
        }
    )
    open_ = F.when(F.col("most") / F.col("weight") >= F.col("left") / F.col("weights"), F.col("left") / F.col("weights"))
    level = F.max(open_).over(everything)
    return shares.withColumn("level", level).select(
        "source", "source_size", "source_no",
        F.when(F.col("most") <= F.col("weight") * F.coalesce("level", F.lit(float("inf"))), F.col("most")).otherwise(F.col("weight") * F.col("level")).alias("target"),
    )


def size_class(size: Column) -> Column:
    """Not decreasing in the size: sizes below 256 one by one, then 64 classes per doubling."""
    bits = F.length(F.bin(size)).cast("int")
    return F.when(size < 256, size).otherwise(bits * 128 + F.call_function("shiftright", size, bits - 7))


def _copies(place: Column, rate: Column, offset: Column) -> Column:
    """Integers crossed by the running sum of expected copies at this place."""
    return F.floor(place * rate + offset) - F.floor((place - 1) * rate + offset)


def _first_offset(seed: str, source: Column) -> Column:
    digest = F.md5(F.concat(F.lit(seed), F.coalesce(source, F.lit(""))).cast("binary"))
    return F.conv(F.substring(digest, 1, 3), 16, 10).cast("double") / 4096


def _draw(first: Column, k: int) -> Column:
    """The k-th of ``DRAWS`` offsets, evenly spaced from a random first one."""
    return (first + k / DRAWS) % 1.0


def _placed(docs: DataFrame, p: str, words: Column, source: str, tie: Column | None, drawn: DataFrame | None = None) -> DataFrame:
    """``docs`` plus size, source, source_size, target, rate and place in the order of the source, under the prefix ``p``; and the offset, if ``drawn`` has them.

    What belongs to a source reaches its rows by their bucket, so that no row is ever dealt by its source alone.
    """
    size, group, part, hashed, origin, order = (f"{p}{c}" for c in ("size", "class", "part", "hash", "source", "tie"))
    id_hash = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    rows = docs.withColumns({size: words.cast("bigint"), hashed: id_hash, origin: F.col(source), order: F.lit(0) if tie is None else tie})
    rows = rows.withColumns({group: size_class(F.col(size)), part: F.conv(F.substring(hashed, 1, 2), 16, 10).cast("int")})
    bucket = [origin, group, part]
    counts = rows.groupBy(*bucket).agg(F.count("*").alias("n"), F.sum(size).alias("words"))
    totals = counts.groupBy(F.col(origin).alias("source")).agg(F.sum("words").alias("source_size"))
    before = Window.partitionBy(origin).orderBy(group, part).rowsBetween(Window.unboundedPreceding, -1)
    places = counts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    known = places.join(source_targets(totals), F.col(origin).eqNullSafe(F.col("source")))
    carried = ["before", "source_size", "target"]
    if drawn is not None:
        known = known.join(drawn, F.col(origin).eqNullSafe(F.col("drawn")))
        carried.append("offset")
    known = known.select(*[F.col(c).alias(f"{c}_b") for c in bucket], *[F.col(c).alias(f"{p}{c}") for c in carried])
    match = F.lit(True)
    for c in bucket:
        match = match & F.col(c).eqNullSafe(F.col(f"{c}_b"))
    number = F.row_number().over(Window.partitionBy(*bucket).orderBy(hashed, size, order))
    rate = F.when(F.col(f"{p}source_size") > 0, F.col(f"{p}target") / F.col(f"{p}source_size")).otherwise(F.lit(1.0))
    return rows.join(known, match).withColumns({f"{p}place": F.col(f"{p}before") + number, f"{p}rate": rate})


def _offsets(placed: DataFrame, p: str, seed: str) -> DataFrame:
    """(drawn, offset): of each source's draws, the one whose words come nearest to the target, the first of equals."""
    size, origin, target, place, rate = (F.col(f"{p}{c}") for c in ("size", "source", "target", "place", "rate"))
    first = F.col("first")
    rows = placed.select(origin.alias("source"), size.alias("size"), target.alias("target"), place.alias("place"), rate.alias("rate"), _first_offset(seed, origin).alias("first"))
    sums = [F.sum(_copies(F.col("place"), F.col("rate"), _draw(first, k)) * F.col("size")).alias(f"t{k}") for k in range(DRAWS)]
    taken = rows.groupBy("source", "first").agg(F.first("target").alias("target"), *sums)
    tried = [F.struct(F.abs(F.col(f"t{k}") - F.col("target")).alias("off"), F.lit(k).alias("k"), _draw(first, k).alias("offset")) for k in range(DRAWS)]
    return taken.select(F.col("source").alias("drawn"), F.array_min(F.array(*tried))["offset"].alias("offset"))


def _mixed(docs: DataFrame, p: str, words: Column, source: str, seed: str, tie: Column | None) -> DataFrame:
    drawn = _offsets(_placed(docs, p, words, source, None), p, seed)
    out = _placed(docs, p, words, source, tie, drawn)
    crossed = _copies(F.col(f"{p}place"), F.col(f"{p}rate"), F.col(f"{p}offset")).cast("bigint")
    out = out.withColumn(f"{p}copies", crossed).withColumn(f"{p}taken", F.col(f"{p}copies") * F.col(f"{p}size"))
    return out.select(*docs.columns, *[f"{p}{c}" for c in ("size", "source_size", "target", "copies", "taken")])


def mix(docs: DataFrame, text: str = "text", source: str = "source", seed: str = "mix", tie: Column | None = None) -> tuple[DataFrame, str]:
    """All rows and columns of ``docs`` plus, under the returned prefix, size, source_size, target, copies and taken (copies times size).

    Null texts have size 0.  A null source is a source of its own.  Null ids share one place in the order of hashes; repeated rows are separate
    documents.  Reruns agree; rows equal in id, source and size may swap places unless ``tie`` orders them.
    """
    p = prefix(docs, "m")
    return _mixed(docs, p, n_words(F.col(text)), source, seed, tie), p


def emit(docs: DataFrame, text: str = "text", source: str = "source", seed: str = "mix") -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it.

    Numbers are drawn on narrow rows (id, source, size, key), and the copies of a key are brought to the texts in the only exchange of texts.  The key names
    id, source and text; the copies of rows that agree in all three are shared out evenly among them.
    """
    p = prefix(docs, "m")
    key, held, copies = f"{p}key", f"{p}held", f"{p}copies"
    named = F.md5(F.to_json(F.struct(F.col("doc_id").alias("i"), F.col(source).alias("s"), F.xxhash64(text).alias("t"))).cast("binary"))
    narrow = staged(docs.select("doc_id", F.col(source).alias("source"), n_words(F.col(text)).cast("bigint").alias("words"), named.alias(key)), "mix-sizes")
    mixed = _mixed(narrow, p, F.col("words"), "source", seed, F.col(key))
    taken = mixed.groupBy(key).agg(F.count("*").alias(held), F.sum(copies).alias(copies)).where(F.col(copies) > 0)
    met = docs.withColumn(key, named).join(taken, key)
    place = F.row_number().over(Window.partitionBy(key).orderBy(key))
    share = F.floor(F.col(copies) / F.col(held)) + F.when(place <= F.col(copies) % F.col(held), 1).otherwise(0)
    shared = met.withColumn(copies, share).where(F.col(copies) > 0)
    return shared.select(*docs.columns, F.explode(F.sequence(F.lit(1), F.col(copies).cast("int"))).alias(f"{p}copy")).select(*docs.columns)
