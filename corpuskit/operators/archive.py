"""Concept archive: term lists, alias-resolving lookup, misses, insertion of explanations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuskit.functions.text import clean_concept, compatible, concept_keys, let, normalize_concept
from corpuskit.operators.keyed import append_new, dedupe_first


TERM_SPLIT = r"[\n,;]+"


def parse_terms(requests: DataFrame, raw: str, request_id: str) -> DataFrame:
    """Split a raw list at newline, comma or semicolon; cleaned, distinct by normal form, order kept, per request row."""
    parts = requests.select(request_id, compatible(F.split(F.coalesce(raw, F.lit("")), TERM_SPLIT)).alias("__parts"))
    terms = parts.withColumn("__terms", F.transform("__parts", lambda p: clean_concept(p, unicode=False)))
    pairs = terms.withColumn("__pairs", F.arrays_zip(F.col("__terms").alias("term"), concept_keys(F.col("__terms")).alias("normalized")))

    def firsts(kept: Column) -> Column:
        keys = F.transform(kept, lambda p: p["normalized"])
        return let(keys, lambda ks: F.filter(kept, lambda p, i: F.array_position(ks, p["normalized"]) == i + 1))

    first = let(F.filter("__pairs", lambda p: p["normalized"] != ""), firsts)
    return pairs.select(request_id, F.posexplode(first).alias("pos", "__t")).select(request_id, "pos", "__t.*")


def wanted_terms(requests: DataFrame, normalized: str, original: str, position: list[str]) -> DataFrame:
    """Distinct normal forms with the last spelling asked for; hot terms shrink before the shuffle."""
    return requests.where(F.col(normalized) != "").groupBy(normalized).agg(
        F.max_by(original, F.struct(*position)).alias(original), F.count("*").alias("n_requests")
    )


def resolve_terms(wanted: DataFrame, concepts: DataFrame, aliases: DataFrame, normalized: str = "normalized") -> DataFrame:
    """Concept of each wanted term: a direct name match wins, the rest goes through the alias table.

    ``wanted`` is unique on the normal form.  Adds ``concept_id`` (null: a miss) and ``matched_by``.
    """
    direct = concepts.select(F.col("normalized_name").alias(normalized), F.col("id").alias("__direct"))
    # an alias row without its concept is no hit
    via = (
        aliases.join(concepts.select(F.col("id").alias("concept_id")), "concept_id", "left_semi")
        .groupBy(F.col("alias_normalized").alias(normalized))
        .agg(F.min("concept_id").alias("__via"))
    )
    joined = wanted.join(direct, normalized, "left").join(via, normalized, "left")
    return joined.withColumns(
        {
            "concept_id": F.coalesce("__direct", "__via"),
            "matched_by": F.when(F.col("__direct").isNotNull(), "name").when(F.col("__via").isNotNull(), "alias"),
        }
    ).drop("__direct", "__via")


def term_hits(resolved: DataFrame) -> DataFrame:
    return resolved.where("concept_id IS NOT NULL")


def term_misses(resolved: DataFrame) -> DataFrame:
    return resolved.where("concept_id IS NULL").drop("concept_id", "matched_by")


def alias_union(requested: Column, canonical: Column, aliases: Column) -> Column:
    """Normal forms that should lead to a concept: request, canonical name and aliases without the canonical form."""
    names = F.concat(F.array(requested, canonical), F.coalesce(aliases, F.array().cast("array<string>")))
    normal = F.filter(concept_keys(compatible(names)), lambda n: n != "")
    return F.array_except(F.array_distinct(normal), F.array(normalize_concept(canonical)))


def ingest_explanations(
    concepts: DataFrame, aliases: DataFrame, explanations: DataFrame, order: list[str]
) -> tuple[DataFrame, DataFrame]:
    """New states of (concepts, aliases) after explanations arrive.

    Known concepts and aliases keep what they have; ids derive from the normal form, so a replayed batch changes nothing.
    """
    named = explanations.withColumn("canonical_name", clean_concept("canonical_name"))
    named = named.withColumn("normalized_name", normalize_concept("canonical_name")).where("normalized_name != ''")
    fresh = dedupe_first(named, ["normalized_name"], order).withColumns(
        {
            "id": F.sha2("normalized_name", 256),
            "difficulty": F.coalesce("difficulty", F.lit("intermediate")),
            "quality_status": F.lit("AI_GENERATED"),
            "hit_count": F.lit(0).cast("bigint"),
        }
    )
    new_concepts = append_new(concepts, fresh, ["normalized_name"])
    given = F.coalesce("aliases", F.array().cast("array<string>"))
    offered = named.select(
        "normalized_name", *order, F.explode(F.concat(F.array("requested_term", "canonical_name"), given)).alias("__alias")
    )
    offered = offered.withColumn("alias_display", clean_concept("__alias")).withColumn(
        "alias_normalized", normalize_concept("alias_display")
    )
    offered = offered.where("alias_normalized != '' AND alias_normalized != normalized_name")
    owner = new_concepts.select("normalized_name", F.col("id").alias("concept_id"))
    # one row per alias and concept before the join; the hint keeps Spark from broadcasting them, whose number it underrates after the explode
    distinct = dedupe_first(offered, ["alias_normalized", "normalized_name"], order)
    first = dedupe_first(distinct.hint("merge").join(owner, "normalized_name"), ["alias_normalized"], [*order, "concept_id"])
    return new_concepts, append_new(aliases, first, ["alias_normalized"])


def priority_union(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """Union where the first source wins per folded key; position decides within a source (column ``pos``)."""
    both = first.withColumn("__source", F.lit(0)).unionByName(second.withColumn("__source", F.lit(1)))
    keyed = both.withColumn("__key", F.lower(F.trim(key))).where("__key != ''")
    return dedupe_first(keyed, ["__key"], ["__source", "pos"]).withColumnRenamed("__source", "source_rank").drop("__key")
