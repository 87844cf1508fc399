"""Figure labels, figure keys and panel labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpuskit.functions.text import WS, col, let, strip, text_or_empty

# The label shapes of the three extraction sources and the panel markers of captions.
FIGURE_ANYWHERE = rf"(?i)(?:fig(?:ure)?\.?){WS}*(\d+[A-Za-z]?)"
FIGURE_WORD = rf"(?i)\bfig(?:ure)?\.?{WS}*(\d+[A-Za-z]?)\b"
FIGURE_START = rf"(?i)^{WS}*(?:fig(?:ure)?\.?{WS}*)(\d+[A-Za-z]?){WS}*[.:]?{WS}*"
NON_WORD = r"[^\p{L}\p{N}_]+"
PANEL_MARKER = r"\([A-Z](?:\s*(?:[-–—]|to|and|,|&)\s*[A-Z])*\)"
PANEL_SEPARATOR = r"\s*(?:,|AND|&)\s*"
PANEL_TOKEN = r"^\s*([A-Z])(?:\s*(?:[-–—]|TO)\s*([A-Z]))?\s*$"
COUNTED_MARKER = r"(?i)\(\s*([A-H])(?:\s*(?:and|–|-|to)\s*([A-H]))?\s*\)"
LOOSE_PANEL = r"(?i)(?<![A-Za-z])([A-H])(?=\s*(?:,|and|–|-|\)))"
NO_FIGURES = {"ko": "연결 Figure 없음", "en": "No linked Figures"}
LABELS_SHOWN = 5


def _no_strings() -> Column:
    return F.array().cast("array<string>")


def figure_label_prefix(c: Column | str) -> Column:
    """Card label: a leading ``figure`` / ``fig`` becomes ``Fig. <rest>``; ``Fig. ...`` and everything else stays."""
    value = strip(c)
    low = F.lower(value)

    def rewritten(prefix: str) -> Column:
        rest = F.btrim(F.substring(value, F.lit(len(prefix) + 1), F.length(value)), F.lit(" ."))
        return F.when(rest == "", value).otherwise(F.concat(F.lit("Fig. "), rest))

    return (
        F.when(low.startswith("fig."), value)
        .when(low.startswith("figure"), rewritten("figure"))
        .when(low.startswith("fig"), rewritten("fig"))
        .otherwise(value)
    )


def figure_label_search(c: Column | str) -> Column:
    """First figure number with letter suffix anywhere in the label, else the label itself."""
    value = strip(c)
    number = F.regexp_extract(value, FIGURE_ANYWHERE, 1)
    return F.when(number == "", value).otherwise(F.concat(F.lit("Fig. "), number))


def figure_label_caption(c: Column | str) -> Column:
    """Figure number at the caption start, else the first whole-word one, else empty."""
    value = strip(c)
    at_start, inside = F.regexp_extract(value, FIGURE_START, 1), F.regexp_extract(value, FIGURE_WORD, 1)
    number = F.when(at_start == "", inside).otherwise(at_start)
    return F.when(number == "", F.lit("")).otherwise(F.concat(F.lit("Fig. "), number))


def _key(value: Column, pattern: str) -> Column:
    number = F.regexp_extract(value, pattern, 1)
    suffix = F.lower(F.regexp_extract(value, pattern, 2))
    other = F.regexp_replace(F.lower(value), NON_WORD, "")
    return F.when(number == "", other).otherwise(F.concat(F.lit("fig"), number, suffix))


def figure_label_key(c: Column | str) -> Column:
    """``fig<number><suffix>`` of the searched label."""
    return _key(figure_label_search(c), r"(?i)fig\.\s*(\d+)([A-Za-z]?)")


def figure_any_key(c: Column | str) -> Column:
    """``fig<number><suffix>`` of the first number, with or without the word figure."""
    return _key(text_or_empty(c), r"(\d+)([A-Za-z]?)")


def figure_number(c: Column | str) -> Column:
    """First integer of a label, null if none."""
    return F.regexp_extract(text_or_empty(c), r"(\d+)", 1).try_cast("int")


def figure_integer_key(number: Column) -> Column:
    return F.concat(F.lit("fig"), number.cast("int").cast("string"))


def figure_base_key(key: Column) -> Column:
    """``fig2a`` -> ``fig2``; null where the key has no number."""
    number = F.regexp_extract(key, r"fig(\d+)", 1)
    return F.when(number != "", F.concat(F.lit("fig"), number))


def figure_order_keys(c: Column | str) -> list[Column]:
    """Sort keys: number (9999 without one), then letter suffix, then the label."""
    value = text_or_empty(c)
    return [
        F.coalesce(figure_number(value), F.lit(9999)).asc(),
        F.lower(F.regexp_extract(value, r"(\d+)([A-Za-z]?)", 2)).asc(),
        value.asc(),
    ]


def _letters(first: Column, last: Column) -> Column:
    codes = F.sequence(F.ascii(first), F.ascii(last))
    return (
        F.when(first == "", _no_strings())
        .when(last == "", F.array(first))
        .when(first <= last, F.transform(codes, lambda code: F.char(code)))
        .otherwise(_no_strings())
    )


def expand_panel_labels(c: Column | str) -> Column:
    """``A-C, E`` -> [A, B, C, E]: order kept, duplicates dropped, a descending range yields nothing."""
    tokens = F.split(F.upper(strip(c)), PANEL_SEPARATOR)
    expanded = F.transform(
        tokens, lambda t: _letters(F.regexp_extract(t, PANEL_TOKEN, 1), F.regexp_extract(t, PANEL_TOKEN, 2))
    )
    return F.array_distinct(F.flatten(expanded))


def compact_panel_range(labels: Column | str) -> Column:
    """[A, B, C] -> ``A-C``; labels with gaps stay a comma list; anything but single capitals is ignored."""

    def text(kept: Column) -> Column:
        codes = F.transform(kept, F.ascii)
        first, last = F.try_element_at(codes, F.lit(1)), F.try_element_at(codes, F.lit(-1))
        run = (F.size(kept) >= 2) & (first <= last) & (codes == F.sequence(first, last))
        short = F.concat(F.char(first), F.lit("-"), F.char(last))
        return F.when(F.coalesce(run, F.lit(False)), short).otherwise(F.array_join(kept, ","))

    return let(F.filter(col(labels), lambda x: x.rlike("^[A-Z]$")), text)


def label_preview(labels: Column | str, lang: str = "en") -> Column:
    """First five labels and how many more there are."""
    arr = col(labels)
    shown, more = F.array_join(F.slice(arr, 1, LABELS_SHOWN), ", "), (F.size(arr) - LABELS_SHOWN).cast("string")
    tail = (F.lit(" 외 "), more, F.lit("개")) if lang == "ko" else (F.lit(" +"), more, F.lit(" more"))
    return (
        F.when(F.coalesce(F.size(arr), F.lit(0)) <= 0, F.lit(NO_FIGURES["ko" if lang == "ko" else "en"]))
        .when(F.size(arr) <= LABELS_SHOWN, F.array_join(arr, ", "))
        .otherwise(F.concat(shown, *tail))
    )


def panel_count(c: Column | str) -> Column:
    """Distinct panels A-H that a caption mentions, in brackets (ranges expanded) or loose before a separator."""
    text = text_or_empty(c)
    marked = F.flatten(
        F.transform(
            F.regexp_extract_all(text, F.lit(COUNTED_MARKER), F.lit(0)),
            lambda m: _letters(
                F.upper(F.regexp_extract(m, COUNTED_MARKER, 1)), F.upper(F.regexp_extract(m, COUNTED_MARKER, 2))
            ),
        )
    )
    loose = F.transform(F.regexp_extract_all(text, F.lit(LOOSE_PANEL), F.lit(1)), F.upper)
    return F.size(F.array_distinct(F.concat(marked, loose)))
