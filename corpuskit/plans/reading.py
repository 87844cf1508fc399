"""Plan: from uploaded files to the requests that are still missing, and from responses back into the cache."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuskit.operators.dictionary import term_counts, top_terms
from corpuskit.operators.identity import entity_rollup, resolve_identity
from corpuskit.operators.keyed import dedupe_first, dedupe_last, plan_missing, upsert
from corpuskit.operators.requests import build_stage_requests, parse_responses


# Fixed value: how many methods a request names as hints, the most frequent first.
HINTS = 25


def register_files(files: DataFrame, as_of_year: int) -> tuple[DataFrame, DataFrame]:
    """(entities, file aliases) of ``files(file_hash, filename, title, text, seen)``."""
    known = resolve_identity(files, as_of_year)
    attributes = [
        "normalized_title", "title", "identity_type", "identity_value", "confidence", "document_kind", "doi", "pmcid", "pmid",
        "publication_year",
    ]
    entities = entity_rollup(known, "canonical_key", "seen", attributes, "file_hash")
    aliases = dedupe_last(known.select("file_hash", "canonical_key", "filename", "seen"), ["file_hash"], ["seen", "filename"])
    return entities, aliases


def missing_requests(
    files: DataFrame, aliases: DataFrame, cache: DataFrame, terms: DataFrame, instructions: Mapping[str, str], version: str
) -> DataFrame:
    """Request rows of all (paper, stage) pairs without a current result; ``instructions`` maps stages to their instruction.

    The anti join comes first, so texts are searched only where work is left; one text stands for each paper.
    """
    owned = aliases.select("file_hash", "canonical_key")
    papers = owned.groupBy("canonical_key").agg(F.min("file_hash").alias("file_hash"))
    todo = plan_missing(papers, "canonical_key", list(instructions), cache, version)
    needed = papers.join(todo, "canonical_key", "left_semi")
    # papers are matched first, so only their texts move; one file may be listed several times
    named = files.select("file_hash", "text").join(needed, "file_hash")
    texts = dedupe_first(named, ["file_hash"], ["text"])
    hints = top_terms(term_counts(texts, terms, "canonical_key"), HINTS, "canonical_key")
    listed = hints.groupBy("canonical_key").agg(F.array_sort(F.collect_list(F.struct("rank", "canonical"))).alias("h"))
    described = texts.join(listed.select("canonical_key", F.col("h.canonical").alias("hints")), "canonical_key", "left")
    return build_stage_requests(described.join(todo, "canonical_key"), "canonical_key", instructions, hints="hints")


def store_responses(
    cache: DataFrame, responses: DataFrame, schema: T.StructType, version: str
) -> tuple[DataFrame, DataFrame]:
    """(new cache state, quarantine) for ``responses(canonical_key, depth, stage, response_json, model, updated_at)``."""
    good, bad = parse_responses(responses, schema, "response_json")
    rows = good.select(
        "canonical_key", "depth", "stage", F.lit(version).alias("analysis_version"), F.to_json("parsed").alias("result_json"), "model", "updated_at"
    )
    keys = ["canonical_key", "depth", "stage", "analysis_version"]
    latest = dedupe_last(rows, keys, ["updated_at", "model"])
    return upsert(cache, latest, keys, defaults={"hit_count": F.lit(0)}), bad

