"""Notes behind glossary terms, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpuskit.functions.text import contains_hangul, followed_by_hangul_note, let, lower_keeping_edges, strip

HIDDEN = "\x02"


def outside_parentheses(text: Column) -> Column:
    """The text with everything behind an opening bracket, up to the next bracket, hidden; positions stay the same."""
    pieces = F.regexp_extract_all(text, F.lit(r"(?s)[()][^()]*|[^()]+"), F.lit(0))
    shown = F.transform(pieces, lambda p: F.when(p.startswith("("), F.concat(F.lit("("), F.repeat(F.lit(HIDDEN), F.length(p) - 1))).otherwise(p))
    return F.array_join(shown, "")


def _key(entry: Column) -> Column:
    return F.lower(F.trim(entry["english"]))


def _annotate(state: Column, entry: Column) -> Column:
    """One term in one text: (text, terms done) afterwards.

    The note goes behind the first mention outside brackets, unless a note in Hangul is there already.  A term that holds a bracket itself
    is looked for in the text as it is and annotated only if its first mention is not inside brackets.
    """
    text, done = state["text"], state["done"]
    own = entry["surface"].rlike("[()]")

    def at(place: Column) -> Column:
        size = F.length(entry["surface"])
        found = F.substring(text, place, size)
        shown = F.when(contains_hangul(found), entry["english"]).otherwise(found)
        rest = F.substring(text, place + size, F.length(text))
        noted = F.concat(F.left(text, place - 1), shown, F.lit(" ("), entry["local_form"], F.lit(")"), rest)
        kept = followed_by_hangul_note(text, place + size - 1)
        return F.when(place == 0, state).otherwise(
            F.struct(F.when(kept, text).otherwise(noted).alias("text"), F.concat(done, F.array(_key(entry))).alias("done"))
        )

    def search(visible: Column) -> Column:
        low, needle = lower_keeping_edges(visible), lower_keeping_edges(entry["surface"])
        plain = F.position(needle, low)
        first = F.position(needle, lower_keeping_edges(text))
        inside = F.substring(visible, first, F.lit(1)) == HIDDEN
        return let(F.when(own, F.when(inside, 0).otherwise(first)).otherwise(plain), at)

    wanted = ~F.array_contains(done, _key(entry)) & F.contains(lower_keeping_edges(text), lower_keeping_edges(entry["surface"]))
    return F.when(wanted, let(outside_parentheses(text), search)).otherwise(state)


def annotate_texts(texts: Column, glossary: Column) -> Column:
    """Texts of one bundle with a note behind the first mention of each term, longer terms first; web addresses stay as they are.

    ``glossary`` holds structs of surface, english and local_form.  Terms with the same English form count as one.  Null texts stay null.
    """
    usable = F.filter(glossary, lambda g: (F.coalesce(g["surface"], F.lit("")) != "") & (strip(g["english"]) != ""))
    entries = F.array_sort(usable, lambda a, b: F.length(b["surface"]) - F.length(a["surface"]))
    none = F.array().cast("array<string>")

    def text_step(state: Column, text: Column) -> Column:
        start = F.struct(text.alias("text"), state["done"].alias("done"))
        skip = text.isNull() | (text == "") | text.startswith("http://") | text.startswith("https://")
        after = F.when(skip, start).otherwise(F.aggregate(entries, start, _annotate))
        return let(after, lambda s: F.struct(F.concat(state["out"], F.array(s["text"])).alias("out"), s["done"].alias("done")))

    start = F.struct(none.alias("out"), none.alias("done"))
    return F.when(texts.isNull() | glossary.isNull(), texts).otherwise(F.aggregate(texts, start, text_step, lambda s: s["out"]))
