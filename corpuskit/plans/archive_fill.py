"""Plan: requested terms to archive hits and to batches for the misses; explanations back into the archive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuskit.operators import archive
from corpuskit.operators.keyed import add_hits, count_hits
from corpuskit.operators.requests import batch_terms


def lookup(requests: DataFrame, concepts: DataFrame, aliases: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(hits, misses, concepts with the new hit counts) for ``requests(request_id, raw)``.

    Hits count once per request and concept, however many of its names were asked for.
    """
    terms = archive.parse_terms(requests, "raw", "request_id")
    wanted = archive.wanted_terms(terms, "normalized", "term", ["request_id", "pos"])
    resolved = archive.resolve_terms(wanted, concepts, aliases)
    hits = archive.term_hits(resolved)
    asked = terms.join(hits.select("normalized", F.col("concept_id").alias("id")), "normalized")
    counted = add_hits(concepts, count_hits(asked, "id", "request_id"), "id")
    return hits, archive.term_misses(resolved), counted


def miss_batches(misses: DataFrame) -> DataFrame:
    """Misses in batches of eight.  Terms are dealt to groups by digest, so no single group holds them all."""
    group = F.left(F.sha2("normalized", 256), F.lit(3))
    rows = misses.select(group.alias("group"), "term", F.xxhash64("normalized").alias("position"))
    # the top bits of the digest follow its order and cut a group into pieces
    return batch_terms(rows, "group", "term", "position", F.shiftright("position", 56))
