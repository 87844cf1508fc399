"""Splitting text into points and chunks, and collecting text from bundles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpuskit.functions.text import WS, col, squeeze, strip

# Split patterns and size limits.
POINT_SPLIT = rf"(?<=[.!?。]){WS}+|;{WS}+"
POINT_OR_LINE_SPLIT = rf"(?<=[.!?。]){WS}+|;{WS}+|\n+"
CLAUSE_SPLIT = rf",{WS}+(?=[A-Za-z가-힣])"
SENTENCE_SPLIT = r"(?<=[.!?]) +"
BULLET_CHARS = " •-\t"
CHUNK_CHARS, FALLBACK_CHUNK_CHARS = 4200, 450


def _non_empty(parts: Column) -> Column:
    return F.filter(parts, lambda p: p != "")


def _points(c: Column | str, pattern: str, clean, long_text: int, max_points: int | None) -> Column:
    text = strip(c)
    points = _non_empty(F.transform(F.split(text, pattern), clean))
    clauses = _non_empty(F.transform(F.split(text, CLAUSE_SPLIT), strip))
    chosen = F.when((F.size(points) <= 1) & (F.length(text) > long_text), clauses).otherwise(points)
    return chosen if max_points is None else F.slice(chosen, 1, max_points)


def sentence_points(c: Column | str, max_points: int | None = None) -> Column:
    """Sentences of a paragraph (the first ``max_points``, if given); one long unbroken sentence is split at its clauses instead."""
    return _points(c, POINT_SPLIT, strip, 90, max_points)


def split_points(c: Column | str, max_points: int | None = None) -> Column:
    """As ``sentence_points``, but lines split too and bullets are stripped."""
    return _points(c, POINT_OR_LINE_SPLIT, lambda p: F.btrim(p, F.lit(BULLET_CHARS)), 100, max_points)


def chunk_text(c: Column | str, max_chars: int = CHUNK_CHARS) -> Column:
    """Whole sentences packed greedily into chunks of at most ``max_chars``; a longer sentence is cut hard.

    The chunks joined, blanks ignored, equal the text.
    """
    none = F.array().cast("array<string>")
    sentences = _non_empty(F.split(squeeze(c), SENTENCE_SPLIT))

    def step(acc: Column, s: Column) -> Column:
        done, cur = acc["done"], acc["cur"]
        fits = F.length(cur) + F.length(s) + 1 <= max_chars
        short = F.length(s) <= max_chars
        full = F.floor(F.length(s) / max_chars).cast("int")
        pieces = F.transform(
            F.sequence(F.lit(0), full - 1), lambda i: F.substring(s, i * max_chars + 1, F.lit(max_chars))
        )
        closed = F.when(cur == "", done).otherwise(F.concat(done, F.array(cur)))
        return F.struct(
            F.when(fits, done).when(short, closed).otherwise(F.concat(closed, pieces)).alias("done"),
            F.when(fits & (cur == ""), s)
            .when(fits, F.concat(cur, F.lit(" "), s))
            .when(short, s)
            .otherwise(F.substring(s, full * max_chars + 1, F.lit(max_chars)))
            .alias("cur"),
        )

    start = F.struct(none.alias("done"), F.lit("").alias("cur"))
    return F.aggregate(
        sentences, start, step, lambda acc: F.concat(acc["done"], F.when(acc["cur"] == "", none).otherwise(F.array(acc["cur"])))
    )


def collect_text(parts: Column | str, max_chars: int | None = None) -> Column:
    """Visible text of a bundle: URLs and one-letter strings skipped, joined by newlines; up to ``max_chars``, if given."""
    texts = F.filter(
        F.transform(col(parts), strip),
        lambda t: (F.length(t) >= 2) & ~t.startswith("http://") & ~t.startswith("https://"),
    )
    if max_chars is None:
        return F.array_join(texts, "\n")
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(0).alias("used"))

    def step(acc: Column, t: Column) -> Column:
        piece = F.left(t, F.lit(max_chars) - acc["used"])
        room = acc["used"] < max_chars
        return F.struct(
            F.when(room, F.concat(acc["out"], F.array(piece))).otherwise(acc["out"]).alias("out"),
            F.when(room, acc["used"] + F.length(piece) + 1).otherwise(acc["used"]).alias("used"),
        )

    return F.aggregate(texts, start, step, lambda acc: F.array_join(acc["out"], "\n"))
