"""Plan: the method corpus tagged, overlaid with stored facets, counted, filtered and searched."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuskit.functions.text import normalize_method_name
from corpuskit.operators.panels import figure_panel_text, match_terms, panel_usage
from corpuskit.operators.search import rank_matches
from corpuskit.operators.taxonomy import facet_counts, filter_facets, method_haystack, overlay_facets, tag_facets
from corpuskit.sources import profiles as source


def tagged_methods(profiles: DataFrame, stored: DataFrame) -> DataFrame:
    """Methods with inferred facets, overlaid by stored ones of the current version."""
    methods = source.methods(profiles)
    hay = method_haystack("name", "category", "parent_method", "aliases", "submethods")
    keyed = tag_facets(methods, hay).withColumn("normalized_name", normalize_method_name("name"))
    return overlay_facets(keyed, stored, "normalized_name")


def browse(profiles: DataFrame, stored: DataFrame, selected: Mapping[str, Sequence[str]]) -> tuple[DataFrame, DataFrame]:
    """(facet counts over all methods, methods that pass the selection)."""
    tagged = tagged_methods(profiles, stored)
    return facet_counts(tagged, "name"), filter_facets(tagged, selected)


def search(profiles: DataFrame, queries: Sequence[str]) -> DataFrame:
    return rank_matches(source.methods(profiles), queries)


def panel_map(profiles: DataFrame) -> DataFrame:
    """Panels of every linked figure that use the method."""
    terms = profiles.select("name", match_terms("name", "aliases").alias("terms"))
    usage = panel_usage(source.method_figures(profiles).join(terms, "name"))
    return usage.withColumn("header", figure_panel_text())


def with_images(figures: DataFrame, image_index: DataFrame) -> DataFrame:
    """Figures with the link of their image, if the index has one."""
    return figures.join(image_index, ["pmcid", "figure"], "left").withColumn("has_image", F.col("href").isNotNull())
