"""Normalisers, cleaners, cutters and predicates over text columns."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The white-space set of Unicode text (Java's \s is ASCII only).
WS = r"[\s\x0B\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
WS_CHARS = "".join(
    chr(c) for c in (*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
)

# Limits and character sets of the data products.
CONCEPT_EDGE_CHARS = " \t\r\n.,;:!?()[]{}\"'`"
PANEL_TEXT_CHARS = 360
SNIPPET_BEFORE, SNIPPET_AFTER = 250, 450
REFERENCE_HEADING = rf"(?i)^{WS}*(references|bibliography){WS}*$"
REFERENCE_MIN_POSITION = 0.55
COMPACT_HEAD_SHARE = 0.68
COMPACT_MARKER = "\n\n[... middle of paper omitted for request size ...]\n\n"
ERROR_PAGE_MARKERS = (
    "error 500",
    "server error",
    "that's an error",
    "that’s an error",
    "that's all we know",
    "that’s all we know",
    "<html",
    "<!doctype html",
    "service unavailable",
    "bad gateway",
    "gateway timeout",
)
SUPPLEMENT_MARKERS = (
    "supplementary information",
    "supporting information",
    "supplementary material",
    "supplemental material",
    "supplemental information",
    "supporting materials",
)


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind an expensive value once and use it several times in ``body``.

    Also needed for values used inside a lambda: Spark merges projections, and a column inlined into a lambda would be computed
    again for every element.
    """
    return F.transform(F.array(value), body)[0]


def text_or_empty(c: Column | str) -> Column:
    return F.coalesce(col(c).cast("string"), F.lit(""))


def fold(c: Column | str) -> Column:
    """Case folding with JVM functions: lower case plus the two letters of common text where folding differs from it."""
    low = F.lower(text_or_empty(c))
    return F.replace(F.replace(low, F.lit("ß"), F.lit("ss")), F.lit("ς"), F.lit("σ"))


def lower_keeping_edges(c: Column | str) -> Column:
    """Lower case in which no other letter turns into an ASCII one, so ASCII word edges never move.

    The only two letters that would, the dotted capital I and the Kelvin sign, are mapped to neighbours first.
    """
    return F.lower(F.translate(text_or_empty(c), "\u0130\u212a", "\u0131\u0138"))


def blanked(c: Column | str) -> Column:
    """Every white-space character becomes a blank; much cheaper than a regex over the whole class."""
    return F.translate(text_or_empty(c), WS_CHARS, " " * len(WS_CHARS))


def squeeze(c: Column | str) -> Column:
    """Every run of white space becomes one blank; both ends trimmed."""
    return F.trim(F.regexp_replace(blanked(c), " {2,}", " "))


def strip(c: Column | str) -> Column:
    return F.btrim(text_or_empty(c), F.lit(WS_CHARS))


def count_of(c: Column, ch: str) -> Column:
    """Number of times the single character ``ch`` occurs."""
    return F.length(c) - F.length(F.replace(c, F.lit(ch), F.lit("")))


def word_count(c: Column | str) -> Column:
    return F.regexp_count(blanked(c), F.lit("[^ ]+"))


def count_in_class(c: Column, letters: str) -> Column:
    """Number of characters in a regex class ``[...]``.  Letters come in runs, so removing runs is cheaper than counting hits."""
    return F.length(c) - F.length(F.regexp_replace(c, f"{letters}+", ""))


def contains_any(c: Column, markers: Sequence[str]) -> Column:
    out = F.lit(False)
    for marker in markers:
        out = out | c.contains(marker)
    return out


SEPARATOR = "\x01"


def mapped(strings: Column, udf: Callable[[Column], Column]) -> Column:
    """A UDF over each string of an array: UDFs can't run in a lambda, so the strings go through it joined.  Nulls vanish."""
    joined = udf(F.array_join(F.transform(strings, lambda s: F.translate(s, SEPARATOR, " ")), SEPARATOR))
    return F.when(F.size(F.array_compact(strings)) == 0, F.array().cast("array<string>")).otherwise(F.split(joined, SEPARATOR))


def compatible(strings: Column) -> Column:
    """NFKC over an array of strings."""
    from corpuskit.functions.python_udfs import nfkc

    return mapped(strings, nfkc)


def concept_keys(strings: Column) -> Column:
    """``normalize_concept`` over an array of strings that are already compatible."""
    from corpuskit.functions.python_udfs import casefold

    return mapped(F.transform(strings, lambda s: F.btrim(squeeze(s), F.lit(CONCEPT_EDGE_CHARS))), casefold)


# --- normalisers ---------------------------------------------------------------------------------------------------


def _compat(c: Column | str, unicode: bool) -> Column:
    from corpuskit.functions.python_udfs import nfkc

    return nfkc(text_or_empty(c)) if unicode else text_or_empty(c)


def _folded(c: Column, unicode: bool) -> Column:
    from corpuskit.functions.python_udfs import casefold

    return casefold(c) if unicode else fold(c)


def normalize_concept(c: Column | str, unicode: bool = True) -> Column:
    """Matching key of a concept, from the whole string, under NFKC and full case folding (Arrow UDF).

    ``unicode=False`` is for use inside lambdas, where UDFs can't run: the caller maps the strings first (``compatible``).
    """
    return _folded(F.btrim(squeeze(_compat(c, unicode)), F.lit(CONCEPT_EDGE_CHARS)), unicode)


def clean_concept(c: Column | str, unicode: bool = True) -> Column:
    """Display form of a concept."""
    return squeeze(_compat(c, unicode))


def single_term(c: Column | str) -> Column:
    """The whole input is one term: no splitting, no compatibility mapping."""
    return squeeze(c)


def normalize_method_name(c: Column | str, unicode: bool = False) -> Column:
    """Blank, underscore, dash and slash runs become one blank."""
    folded = _folded(_compat(c, unicode), unicode)
    return F.trim(F.regexp_replace(folded, WS[:-1] + r"_\-/]+", " "))


def normalize_match_text(c: Column | str) -> Column:
    """Letters a-z, digits and Hangul syllables; everything else is one blank."""
    return F.trim(F.regexp_replace(fold(c), "[^a-z0-9가-힣]+", " "))


def normalize_title(c: Column | str, unicode: bool = True) -> Column:
    """Letters a-z and digits under NFKC and full case folding (plain UDFs: whole texts are titled, too); everything else is one blank."""
    from corpuskit.functions.python_udfs import casefold_text, nfkc_text

    folded = casefold_text(nfkc_text(text_or_empty(c))) if unicode else _folded(_compat(c, unicode), unicode)
    return F.trim(F.regexp_replace(folded, "[^a-z0-9]+", " "))


def join_hyphenated(c: Column | str) -> Column:
    """NUL to blank, rejoin words cut at a line end, squeeze."""
    no_nul = F.translate(text_or_empty(c), "\x00", " ")
    return squeeze(F.regexp_replace(no_nul, rf"-{WS}*\n{WS}*", ""))


def clean_text(c: Column | str) -> Column:
    """``join_hyphenated`` after entity decoding (plain UDF: Spark has no HTML decoder)."""
    from corpuskit.functions.python_udfs import unescape_text

    return join_hyphenated(unescape_text(text_or_empty(c)))


def _drop_unmatched(c: Column, opener: str, closer: str) -> Column:
    excess = F.greatest(count_of(c, closer) - count_of(c, opener), F.lit(0))
    tail = F.length(F.regexp_extract(c, "\\" + closer + "+$", 0))
    return F.left(c, F.length(c) - F.least(excess, tail))


def clean_doi(c: Column | str) -> Column:
    """Bare lower-case DOI: no resolver prefix, no trailing punctuation, no unmatched closing bracket."""
    bare = F.regexp_replace(strip(c), rf"(?i)^(?:https?://(?:dx\.)?doi\.org/|doi:{WS}*)", "")
    bare = F.rtrim(strip(bare), F.lit(".,;:"))
    rounded = let(bare, lambda v: _drop_unmatched(v, "(", ")"))
    return F.lower(let(rounded, lambda v: _drop_unmatched(v, "[", "]")))


# --- cutters -------------------------------------------------------------------------------------------------------


def concise_text(c: Column | str, max_chars: int = PANEL_TEXT_CHARS) -> Column:
    """Squeezed text; if longer than the limit, cut back to the last whole word and marked with an ellipsis."""

    def shorten(flat: Column) -> Column:
        cut = F.regexp_replace(F.substring(flat, 1, max_chars), r" [^ ]*$", "")
        return F.when(F.length(flat) <= max_chars, flat).otherwise(F.concat(cut, F.lit("…")))

    return let(squeeze(c), shorten)


def keyword_snippet(c: Column | str, keyword: str) -> Column:
    """Window around the first hit of the keyword; the whole text where there is no hit or no keyword."""
    text = text_or_empty(c)
    if not keyword:
        return text

    def window(pos: Column) -> Column:
        start = F.greatest(F.lit(0), pos - SNIPPET_BEFORE)
        end = F.least(F.length(text), pos + len(keyword) + SNIPPET_AFTER)
        return F.when(pos >= 0, F.substring(text, start + 1, end - start)).otherwise(text)

    return let(F.locate(keyword.casefold(), F.lower(text)) - 1, window)


def _reference_offset(text: Column) -> Column:
    """0-based offset of the first late reference heading, -1 if none.

    A heading owns the blank lines in front of it, so it starts at the first of them.
    """
    start = F.struct(F.lit(0).alias("at"), F.lit(-1).alias("blank"), F.lit(-1).alias("hit"))

    def step(state: Column, line: Column, late: Column) -> Column:
        begin = F.when(state["blank"] >= 0, state["blank"]).otherwise(state["at"])
        found = (state["hit"] < 0) & (begin > late) & line.rlike(REFERENCE_HEADING)
        return F.struct(
            (state["at"] + F.length(line) + 1).alias("at"),
            F.when(strip(line) == "", begin).otherwise(-1).alias("blank"),
            F.when(found, begin).otherwise(state["hit"]).alias("hit"),
        )

    return let(
        F.length(text) * F.lit(REFERENCE_MIN_POSITION),
        lambda late: F.aggregate(F.split(text, "\n"), start, lambda s, line: step(s, line, late), lambda s: s["hit"]),
    )


def cut_reference_list(c: Column | str) -> Column:
    """Drop everything from the first late reference heading that stands on its own line."""

    def cut(text: Column) -> Column:
        may_have = F.lower(text).rlike("references|bibliography")
        return F.when(
            may_have, let(_reference_offset(text), lambda at: F.when(at >= 0, F.left(text, at)).otherwise(text))
        ).otherwise(text)

    return let(strip(c), cut)


def compact_text(c: Column | str, max_chars: int | None = None) -> Column:
    """Text without its reference list.  With a limit, head and tail around a marker; ``omitted_chars`` tells how much the marker stands for."""
    if max_chars is None:
        return cut_reference_list(c)
    head = int(max_chars * COMPACT_HEAD_SHARE)
    tail = max_chars - head
    return let(
        cut_reference_list(c),
        lambda text: F.when(F.length(text) <= max_chars, text).otherwise(
            F.concat(F.left(text, F.lit(head)), F.lit(COMPACT_MARKER), F.right(text, F.lit(tail)))
        ),
    )


def omitted_chars(c: Column | str, max_chars: int) -> Column:
    """Characters that ``compact_text`` leaves out for the limit, besides the reference list."""
    return let(cut_reference_list(c), lambda text: F.greatest(F.length(text) - max_chars, F.lit(0)))


def text_slices(c: Column | str, max_chars: int) -> Column:
    """The text in consecutive slices of at most ``max_chars`` characters; an empty text is one empty slice."""

    def slices(text: Column) -> Column:
        last = F.greatest(F.ceil(F.length(text) / max_chars).cast("int") - 1, F.lit(0))
        return F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(text, i * max_chars + 1, F.lit(max_chars)))

    return let(text_or_empty(c), slices)


# --- predicates ----------------------------------------------------------------------------------------------------


def script_ratio(c: Column | str, script: str, letters: str) -> Column:
    """Share of ``script`` characters among ``letters`` (both regex classes); null where there are no letters."""
    text = text_or_empty(c)
    return count_in_class(text, script) / F.nullif(count_in_class(text, letters), F.lit(0))


def mostly_script(c: Column | str, script: str, letters: str, threshold: float = 0.55) -> Column:
    """Empty text counts as already in the script, text without letters does not."""
    ratio = F.coalesce(script_ratio(c, script, letters) > threshold, F.lit(False))
    return F.when(text_or_empty(c) == "", True).otherwise(ratio)


def mostly_korean(c: Column | str) -> Column:
    return mostly_script(c, "[가-힣]", "[A-Za-z가-힣]")


def contains_hangul(c: Column | str) -> Column:
    return text_or_empty(c).rlike("[가-힣]")


def is_error_page(c: Column | str, markers: Sequence[str] = ERROR_PAGE_MARKERS) -> Column:
    text = text_or_empty(c)
    return (text == "") | contains_any(F.lower(text), markers)


def punctuation_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit("[.,;:]"))


# Fixed value: a caption block starts with its figure number; references inside prose never match.
CAPTION_START = rf"(?i)^{WS}*(?:fig(?:ure)?\.?{WS}*)(\d+)\b"
CAPTION_START_LETTER = rf"(?i)^{WS}*((?:fig(?:ure)?\.?{WS}*)\d+[A-Za-z]?){WS}*[.:]?{WS}+"


def is_prose(c: Column | str) -> Column:
    """Strict detector: enough words, most of them alphabetic, some punctuation, not a caption.  Cheap tests come first."""

    def strict(text: Column) -> Column:
        alpha = F.regexp_count(text, F.lit(r"(?U)\b[A-Za-z][A-Za-z-]{2,}\b"))
        enough = let(word_count(text), lambda n: (n >= 20) & let(alpha, lambda a: (a >= 10) & (a / n >= 0.35)))
        return (F.length(text) >= 39) & ~text.rlike(CAPTION_START) & (punctuation_count(text) >= 2) & enough

    return let(strip(c), strict)


def is_body_prose(c: Column | str) -> Column:
    """Length-based variant: 120 characters, 22 words, not a caption."""
    return let(
        strip(c),
        lambda text: (F.length(text) >= 120)
        & ~text.rlike(CAPTION_START_LETTER)
        & (punctuation_count(text) >= 2)
        & (word_count(text) >= 22),
    )


def is_loose_prose(c: Column | str) -> Column:
    """Loosest variant: 20 words and two punctuation marks."""
    return let(strip(c), lambda text: (punctuation_count(text) >= 2) & (word_count(text) >= 20))


def inside_parentheses(text: Column, pos: Column) -> Column:
    """True where the last bracket before 0-based ``pos`` is an opening one."""
    before = F.reverse(F.left(text, pos))
    opened, closed = F.locate("(", before), F.locate(")", before)
    return (opened > 0) & ((closed == 0) | (opened < closed))


def followed_by_hangul_note(text: Column, end: Column) -> Column:
    """True where a parenthesis holding Hangul follows 0-based ``end``, however long it is."""
    return F.substring(text, end + 1, F.length(text)).rlike(rf"^{WS}*\([^)]*[가-힣][^)]*\)")


# --- numbers and digests -------------------------------------------------------------------------------------------


def safe_int(c: Column | str, default: int) -> Column:
    """Integer with thousands commas allowed, else the default."""
    digits = F.trim(F.replace(col(c).cast("string"), F.lit(","), F.lit("")))
    return F.coalesce(F.when(digits.rlike(r"^[+-]?\d+$"), digits.try_cast("bigint")), F.lit(default).cast("bigint"))


def bounded_int(c: Column | str, default: int, low: int, high: int) -> Column:
    number = F.coalesce(col(c).try_cast("bigint"), F.lit(default).cast("bigint"))
    return F.greatest(F.lit(low).cast("bigint"), F.least(F.lit(high).cast("bigint"), number))


def content_hash(c: Column | str) -> Column:
    return F.sha2(col(c), 256)


def title_digest(title: Column | str, unicode: bool = True) -> Column:
    return F.left(F.sha2(normalize_title(title, unicode), 256), F.lit(24))


def legend_digest(legend: Column | str) -> Column:
    return F.left(F.sha2(squeeze(fold(legend)), 256), F.lit(16))


def figure_stage_key(label: Column | str, legend: Column | str) -> Column:
    """Cache identity of one figure within a paper: cleaned label plus legend digest."""
    raw = F.when(text_or_empty(label) == "", F.lit("figure")).otherwise(text_or_empty(label))
    clean = F.btrim(F.regexp_replace(raw, "[^A-Za-z0-9_.-]+", "_"), F.lit("_"))
    return F.concat(F.lit("single_figure:"), clean, F.lit(":legend_"), legend_digest(legend))
