"""Captions to panels, and panels to methods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuskit.functions.labels import (
    PANEL_MARKER,
    compact_panel_range,
    expand_panel_labels,
    figure_label_prefix,
    label_preview,
)
from corpuskit.functions.text import concise_text, let, normalize_match_text, strip

PANEL_EDGE_CHARS = " .;:-"


def preamble(caption: Column | str) -> Column:
    """Caption text before the first panel marker."""
    return strip(F.element_at(F.split(strip(caption), PANEL_MARKER), 1))


def caption_panels(caption: Column | str) -> Column:
    """Panels of a caption: array of (labels, raw_label, text).

    Text between a marker and the next one belongs to all labels of the marker.  A marker that expands to no label yields no
    panel but still ends the text of the one before it.
    """
    text = strip(caption)
    markers = F.regexp_extract_all(text, F.lit(PANEL_MARKER), F.lit(0))
    bodies = let(F.split(text, PANEL_MARKER), lambda parts: F.slice(parts, F.lit(2), F.size(parts)))
    panels = F.transform(
        F.arrays_zip(markers.alias("marker"), bodies.alias("body")),
        lambda p: F.struct(
            expand_panel_labels(F.btrim(p["marker"], F.lit("()"))).alias("labels"),
            F.btrim(p["marker"], F.lit("()")).alias("raw_label"),
            F.btrim(p["body"], F.lit(PANEL_EDGE_CHARS)).alias("text"),
        ),
    )
    return F.filter(panels, lambda p: F.size(p["labels"]) > 0)


def split_panels(captions: DataFrame, keys: list[str], caption: str = "caption") -> DataFrame:
    """One row per panel, numbered from 0 within its caption."""
    rows = captions.select(*keys, preamble(caption).alias("preamble"), F.posexplode_outer(caption_panels(caption)).alias("pos", "__p"))
    return rows.select(*keys, "preamble", "pos", "__p.*")


def match_terms(name: str, aliases: str) -> Column:
    """Normalised distinct name and aliases of a method."""
    raw = F.concat(F.array(F.col(name)), F.coalesce(F.col(aliases), F.array().cast("array<string>")))
    return F.filter(F.array_distinct(F.transform(raw, normalize_match_text)), lambda t: t != "")


def _mentions(text: Column, terms: Column, mode: str) -> Column:
    normal = normalize_match_text(text)
    if mode == "word":
        padded = F.concat(F.lit(" "), normal, F.lit(" "))
        return let(padded, lambda n: F.exists(terms, lambda t: F.contains(n, F.concat(F.lit(" "), t, F.lit(" ")))))
    return let(normal, lambda n: F.exists(terms, lambda t: F.contains(n, t)))


def panel_usage(figures: DataFrame, caption: str = "caption", terms: str = "terms", mode: str = "substring") -> DataFrame:
    """Which panels of a linked figure use the method.

    Input: one row per (figure, method) with the normalised ``terms`` of the method.  Adds ``preamble``, ``all_panels``,
    ``usages`` (labels, raw_label, status, text) and ``mode``.  A panel that names the method is ``explicit``; if only the
    preamble names it, every other panel is ``figure_context``; without either the figure is ``linked_only``.
    ``mode='substring'`` has no word edges, ``mode='word'`` asks for whole words.
    """
    rows = figures.withColumns({"__panels": caption_panels(caption), "__pre": preamble(caption)})

    def usage(p: Column, words: Column, in_preamble: Column) -> Column:
        status = F.when(_mentions(p["text"], words, mode), "explicit").when(in_preamble, "figure_context")
        return F.struct(
            p["labels"].alias("labels"),
            p["raw_label"].alias("raw_label"),
            status.alias("status"),
            concise_text(p["text"]).alias("text"),
        )

    def usages(words: Column) -> Column:
        return let(
            _mentions(F.col("__pre"), words, mode), lambda hit: F.transform("__panels", lambda p: usage(p, words, hit))
        )

    rows = rows.withColumn("usages", F.filter(let(F.col(terms), usages), lambda u: u["status"].isNotNull()))
    return rows.withColumns(
        {
            "mode": F.when(F.size("usages") > 0, "panel_map").otherwise("linked_only"),
            "preamble": concise_text("__pre"),
            "all_panels": F.flatten(F.col("__panels.labels")),
        }
    ).drop("__panels", "__pre")


def used_labels(usages: str = "usages") -> Column:
    """Distinct panel labels that use the method, in caption order."""
    return F.array_distinct(F.flatten(F.col(f"{usages}.labels")))


def figure_panel_text(figure: str = "figure", usages: str = "usages") -> Column:
    """``Fig. 2A-C``: figure label with the compacted panels, or the label alone."""
    return F.concat(figure_label_prefix(F.coalesce(figure, F.lit("Figure"))), compact_panel_range(used_labels(usages)))


def paper_panel_index(usage: DataFrame, keys: list[str], position: str, lang: str = "en") -> DataFrame:
    """Preview text of all distinct figure headers of a paper, in order of ``position``.

    Headers are reduced to distinct ones before the list is built; a paper has no more of them than figures.
    """
    texts = usage.select(*keys, position, figure_panel_text().alias("__text"))
    first = texts.groupBy(*keys, "__text").agg(F.min(position).alias("__pos"))
    listed = first.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("__pos", "__text"))).alias("__l"))
    labels = F.filter(F.col("__l.__text"), lambda t: t != "")
    return listed.select(*keys, F.size(labels).alias("n_labels"), label_preview(labels, lang).alias("panel_index"))
