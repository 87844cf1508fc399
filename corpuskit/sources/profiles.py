"""Nested method corpus and image index, flattened to tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuskit.sources.tables import read_or_empty

PROFILE = (
    "name string, aliases array<string>, category string, parent_method string, submethods array<string>, "
    "paper_count bigint, figure_count bigint, "
    "frequently_co_used_methods array<struct<method: string, paper_count: bigint>>, "
    "papers array<struct<pmcid: string, doi: string, title: string, year: int, "
    "figures: array<struct<figure: string, caption: string>>>>"
)
IMAGE_INDEX = "map<string, map<string, struct<href: string>>>"


def load_profiles(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Method profiles as JSON lines (splittable), or one JSON array per file with ``multi_line``.  Missing means empty."""
    return read_or_empty(spark, path, PROFILE, "json", multiLine=str(multi_line).lower())


def parse_profiles(rows: DataFrame, body: str) -> DataFrame:
    """Profiles held as JSON text in a column."""
    return rows.select(F.from_json(body, PROFILE).alias("p")).select("p.*")


def load_image_index(spark: SparkSession, path: str) -> DataFrame:
    """``pmcid -> figure -> {href}`` as rows (pmcid, figure, href).

    The file is one object with a key per paper, so it is read as text and parsed as a map.
    """
    text = read_or_empty(spark, path, "value string", "text", wholetext="true")
    return flatten_image_index(text.select(F.from_json("value", IMAGE_INDEX).alias("index")), "index")


def flatten_image_index(rows: DataFrame, index: str) -> DataFrame:
    papers = rows.select(F.explode(index).alias("pmcid", "__figures"))
    figures = papers.select("pmcid", F.explode("__figures").alias("figure", "__f"))
    return figures.select("pmcid", "figure", F.col("__f.href").alias("href")).where("href IS NOT NULL AND href != ''")


def methods(profiles: DataFrame) -> DataFrame:
    return profiles.select("name", "category", "parent_method", "aliases", "submethods").where("name != ''")


def method_terms(profiles: DataFrame) -> DataFrame:
    """(alias, canonical, pos): the name itself first, then its aliases.  Repeated aliases stay."""
    terms = F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))
    rows = profiles.select(F.col("name").alias("canonical"), F.posexplode(terms).alias("pos", "alias"))
    return rows.where("alias IS NOT NULL AND alias != ''").select("alias", "canonical", "pos")


def method_papers(profiles: DataFrame) -> DataFrame:
    """One row per linked paper, numbered in corpus order."""
    rows = profiles.select("name", F.posexplode("papers").alias("paper_pos", "__p"))
    return rows.select("name", "paper_pos", "__p.pmcid", "__p.doi", "__p.title", "__p.year", "__p.figures")


def method_figures(profiles: DataFrame) -> DataFrame:
    """One row per linked figure."""
    rows = method_papers(profiles).select("name", "paper_pos", "pmcid", F.posexplode("figures").alias("figure_pos", "__f"))
    return rows.select("name", "paper_pos", "pmcid", "figure_pos", "__f.figure", "__f.caption")
