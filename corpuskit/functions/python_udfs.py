"""The few Python UDFs: what Spark's function library lacks.

Those named after texts are plain UDFs: Spark hands them a hundred rows at a time, so that a Python worker's memory follows these, whatever the table's size.  An Arrow
batch holds up to 10,000 rows; the Arrow UDFs are for short strings.
"""

from __future__ import annotations

import difflib
import html
import re
import unicodedata
from collections.abc import Callable, Iterable

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# An Arrow batch stays in its buffers; so many rows of it at a time become Python objects.
ROWS_AT_ONCE = 64


def _each(values: pa.Array, one: Callable[[str], str]) -> pa.Array:
    """``one`` over the strings of a batch."""
    parts = (values.slice(i, ROWS_AT_ONCE) for i in range(0, len(values), ROWS_AT_ONCE))
    done = [pa.array([None if v is None else one(v) for v in part.to_pylist()], values.type) for part in parts]
    return pa.concat_arrays(done) if done else values


def _of_text(one: Callable[[str], str]):
    """Plain UDF of ``one``; null stays null."""
    return F.udf(lambda v: None if v is None else one(v), T.StringType(), useArrow=False)


def _nfkc(v: str) -> str:
    return v if v.isascii() else unicodedata.normalize("NFKC", v)


def _unescaped(v: str) -> str:
    return v if "&" not in v else html.unescape(v)


nfkc_text, casefold_text, unescape_text = _of_text(_nfkc), _of_text(str.casefold), _of_text(_unescaped)


@F.arrow_udf(T.StringType())
def nfkc(s: pa.Array) -> pa.Array:
    return _each(s, _nfkc)


@F.arrow_udf(T.StringType())
def casefold(s: pa.Array) -> pa.Array:
    return _each(s, str.casefold)


@F.arrow_udf(T.StringType())
def unescape_html(s: pa.Array) -> pa.Array:
    return _each(s, _unescaped)


@F.pandas_udf(T.DoubleType())
def gestalt_ratio(query: pd.Series, alias: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp similarity, query first (the measure is not symmetric)."""
    return pd.Series([difflib.SequenceMatcher(None, q, a).ratio() for q, a in zip(query, alias)], dtype="float64")


# Fixed value: symbols kept out of translation.
SYMBOL = (
    r"(?<![A-Za-z0-9])(?:[A-Z]{2,}[A-Z0-9]*|[A-Z]{1,4}-\d+[A-Z0-9-]*|pSTAT\d+)(?![A-Za-z0-9])"
)

OPEN, CLOSE = "\ue000", "\ue001"
TO_MARK = {ord("0") + d: chr(0xE010 + d) for d in range(10)}
FROM_MARK = {0xE010 + d: str(d) for d in range(10)}

PROTECTED = T.StructType(
    [
        T.StructField("text", T.StringType()),
        T.StructField(
            "terms",
            T.ArrayType(
                T.StructType([T.StructField("token", T.StringType()), T.StructField("original", T.StringType())])
            ),
        ),
    ]
)


_SYMBOL = re.compile(SYMBOL)


def protect_text(text: str | None, terms: Iterable[str]) -> tuple[str, list[str]]:
    """The text with placeholders, and the originals by the placeholders' numbers.

    Longest given terms first, then the symbols of the text itself.  Placeholders consist of private-use characters only, so
    no term can match inside one and restoring is exact.
    """
    originals: list[str] = []
    if not text or re.search(f"[{OPEN}{CLOSE}]", text):  # a text that uses our marks itself is left alone
        return text or "", originals

    def put(match: re.Match) -> str:
        originals.append(match.group(0))
        return _token(len(originals) - 1)

    out = text
    given = sorted({t for t in terms if t and len(t) >= 2}, key=lambda t: (-len(t), t))
    for term in given + list(dict.fromkeys(_SYMBOL.findall(text))):
        out = re.sub(re.escape(term), put, out, flags=re.IGNORECASE)
    return out, originals


def _token(number: int) -> str:
    return OPEN + str(number).translate(TO_MARK) + CLOSE


def _protected_text(text: str | None, terms: Iterable[str]) -> tuple[str, list[tuple[str, str]]]:
    out, originals = protect_text(text, terms)
    return out, [(_token(n), original) for n, original in enumerate(originals)]


def protect_terms_text(terms: list[str]):
    """Plain UDF text -> ``protect_text`` with the same terms for all texts."""
    return F.udf(lambda text: _protected_text(text, terms), PROTECTED, useArrow=False)


# ``protect_text`` with the terms listed for each text: those that it holds, from a dictionary of any size.
protect_listed_text = F.udf(lambda text, terms: _protected_text(text, terms or ()), PROTECTED, useArrow=False)


_MARKED = re.compile(f"{OPEN}([\\s\ue010-\ue019]+){CLOSE}")


def _restored(text: str | None, originals: list[str] | None) -> str | None:
    if text is None or not originals:
        return text

    def back(match: re.Match) -> str:
        number = "".join(match.group(1).split()).translate(FROM_MARK)
        return originals[int(number)] if number and int(number) < len(originals) else match.group(0)

    return _MARKED.sub(back, text)


_restore = F.udf(_restored, T.StringType(), useArrow=False)


def restore_text(text: Column | str, terms: Column | str) -> Column:
    """``restore_terms`` as a plain UDF."""
    table = F.col(terms) if isinstance(terms, str) else terms
    return _restore(text, table.getField("original"))


def _protected(texts: pa.Array, terms: Callable[[int], Iterable[str]]) -> pa.Array:
    """``protect_text`` over a batch, ``terms`` by row; the placeholder tables are built as columns, never as one object per placeholder of the batch."""
    entry = pa.struct([("token", pa.string()), ("original", pa.string())])
    done = []
    for i in range(0, len(texts), ROWS_AT_ONCE):
        rows = [protect_text(v, terms(i + k)) for k, v in enumerate(texts.slice(i, ROWS_AT_ONCE).to_pylist())]
        ends = [0]
        for _, originals in rows:
            ends.append(ends[-1] + len(originals))
        tokens = pa.array((_token(n) for _, originals in rows for n in range(len(originals))), pa.string())
        entries = pa.StructArray.from_arrays([tokens, pa.array((o for _, originals in rows for o in originals), pa.string())], fields=list(entry))
        listed = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), entries)
        done.append(pa.StructArray.from_arrays([pa.array([text for text, _ in rows], pa.string()), listed], ["text", "terms"]))
    empty = pa.array([], pa.struct([("text", pa.string()), ("terms", pa.list_(entry))]))
    return pa.concat_arrays(done) if done else empty


def protect_terms_udf(terms: list[str]):
    """UDF text -> ``protect_text`` with the same terms for all texts."""

    @F.arrow_udf(PROTECTED)
    def protect(s: pa.Array) -> pa.Array:
        return _protected(s, lambda row: terms)

    return protect


@F.arrow_udf(PROTECTED)
def protect_listed(text: pa.Array, terms: pa.Array) -> pa.Array:
    """``protect_text`` with the terms listed for each text: those that it holds, from a dictionary of any size."""
    return _protected(text, lambda row: terms[row].as_py() or ())


@F.arrow_udf(T.StringType())
def restore_terms(text: pa.Array, terms: pa.Array) -> pa.Array:
    """Put the originals back; blanks inside a placeholder, which a translator inserts or a cut between chunks leaves, are tolerated."""

    def one(value, table):
        if value is None or not table.is_valid or len(table.values) == 0:
            return value
        return _restored(value, table.values.field("original").to_pylist())

    done = [
        pa.array([one(v, terms[i + k]) for k, v in enumerate(text.slice(i, ROWS_AT_ONCE).to_pylist())], pa.string())
        for i in range(0, len(text), ROWS_AT_ONCE)
    ]
    return pa.concat_arrays(done) if done else text
