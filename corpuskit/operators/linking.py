"""Linking names, labels and files to their targets by tiers, each tier on the remainder of the previous one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuskit.functions.labels import figure_base_key
from corpuskit.functions.python_udfs import gestalt_ratio
from corpuskit.functions.text import let
from corpuskit.operators.dictionary import mention_pairs
from corpuskit.operators.ordered import best_per_key
from corpuskit.session import staged

FUZZY_THRESHOLD = 0.82


def exact_links(names: DataFrame, dictionary: DataFrame) -> DataFrame:
    """All names, with the canonical name of an equal alias if there is one (later dictionary rows win a repeated alias)."""
    unique = dictionary.groupBy(F.col("alias").alias("name")).agg(F.max_by("canonical", "pos").alias("canonical"))
    return names.join(unique, "name", "left").withColumn("tier", F.lit("exact"))


def containment_links(names: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Names inside an alias or holding one: the longest alias wins, then the greatest canonical name."""
    aliases = dictionary.select("alias", "canonical").distinct()
    holds = mention_pairs(names.select("name"), aliases, "name", "name", "alias")
    inside = mention_pairs(aliases.select("alias").distinct(), names.select("name"), "alias", "alias", "name").join(aliases, "alias")
    both = holds.select("name", "alias", "canonical").unionByName(inside.select("name", "alias", "canonical"))
    best = F.max_by("canonical", F.struct(F.length("alias"), "canonical")).alias("canonical")
    return both.groupBy("name").agg(best).withColumn("tier", F.lit("contains"))


def _tagged_bigrams(c: Column) -> Column:
    """Two-character grams, repeated ones numbered, so that the overlap of two sets counts repetitions."""
    listed = F.regexp_extract_all(c, F.lit("(?s)(?=(.{2}))"), F.lit(1))

    def tag(all_grams: Column) -> Column:
        def one(g: Column, i: Column) -> Column:
            seen = F.size(F.filter(F.slice(all_grams, F.lit(1), i), lambda other: other == g))
            return F.concat(g, F.lit("#"), seen.cast("string"))

        return F.transform(all_grams, one)

    return let(listed, tag)


def _rare_grams(side: DataFrame, string: str, spread: DataFrame, threshold: float) -> DataFrame:
    """The grams of each string by which it can be found: its rarest ones, as many as leave too few others for a match.

    A match shares at least t grams with a string of n grams, so one of its rarest n - t + 1 grams is among them; t is least for the shortest partner
    the threshold allows.
    """
    n = F.length(string) - 1
    partner = F.length(string) * threshold / (2 - threshold)
    least = F.greatest(F.ceil((1.5 * threshold - 1) * (F.length(string) + partner) - 1.5), F.lit(1))
    ranked = side.join(spread, "__gram").groupBy(string).agg(F.array_sort(F.collect_list(F.struct("__n", "__gram"))).alias("__g"))
    return ranked.select(string, F.explode(F.slice("__g", F.lit(1), F.greatest(n - least + 1, F.lit(1)).cast("int"))["__gram"]).alias("__gram"))


def fuzzy_candidates(names: DataFrame, aliases: DataFrame, threshold: float = FUZZY_THRESHOLD) -> DataFrame:
    """(name, alias) pairs that share one of the rarest grams of both and whose lengths allow the threshold."""
    left = names.select("name", F.explode(_tagged_bigrams(F.col("name"))).alias("__gram"))
    right = aliases.select("alias", F.explode(_tagged_bigrams(F.col("alias"))).alias("__gram"))
    spread = left.select("__gram").unionAll(right.select("__gram")).groupBy("__gram").agg(F.count("*").alias("__n"))
    la, lb = F.length("name"), F.length("alias")
    near = 2 * F.least(la, lb) / (la + lb) >= threshold
    met = _rare_grams(left, "name", spread, threshold).join(_rare_grams(right, "alias", spread, threshold), "__gram")
    return met.where(near).select("name", "alias").distinct()


def fuzzy_links(names: DataFrame, dictionary: DataFrame, threshold: float = FUZZY_THRESHOLD) -> DataFrame:
    """Closest alias by Ratcliff-Obershelp similarity at or above the threshold; the earliest alias wins ties.

    Candidates are exact.  With L characters together and M of them matched, similarity s = 2M / L leaves L - 2M unmatched ones and
    so at most L - 2M + 1 matching blocks; a block of k characters shares k - 1 grams, hence at least
    M - (L - 2M + 1) = 1.5 s L - L - 1 grams are shared.  That is positive for s >= 0.82 from L = 5 on; shorter pairs reach
    0.82 only when they are equal, which the exact tier has taken.  The bound picks the grams that find a pair, and pairs below it never
    reach the similarity step.
    """
    if threshold < FUZZY_THRESHOLD:
        raise ValueError("candidate blocking is exact only from a threshold of 0.82 on")
    keyed = dictionary.groupBy("alias").agg(F.max_by("canonical", "pos").alias("canonical"), F.min("pos").alias("pos"))
    pairs = fuzzy_candidates(names, keyed.select("alias"), threshold)
    shared = F.size(F.array_intersect(_tagged_bigrams(F.col("name")), _tagged_bigrams(F.col("alias"))))
    # half a gram of slack keeps rounding on the safe side
    enough = shared >= (1.5 * threshold - 1) * (F.length("name") + F.length("alias")) - 1.5
    scored = pairs.where(enough).withColumn("score", gestalt_ratio("name", "alias")).where(F.col("score") >= threshold)
    best = best_per_key(scored.join(keyed, "alias"), ["name"], [F.desc("score"), F.asc("pos")])
    return best.select("name", "canonical", F.lit("fuzzy").alias("tier"))


def entity_links(names: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Canonical target of each distinct name, with the tier that found it.

    ``names(name)`` and ``dictionary(alias, canonical, pos)`` are lower-cased and trimmed.  Each tier is staged: it is used for the
    result and for the remainder that the next, dearer tier works on.
    """
    distinct = names.select("name").where("name != ''").distinct()
    first = staged(exact_links(distinct, dictionary), "links-exact")
    rest = first.where("canonical IS NULL").select("name")
    contained = staged(containment_links(rest, dictionary), "links-contained")
    last = fuzzy_links(rest.join(contained, "name", "left_anti"), dictionary)
    return first.where("canonical IS NOT NULL").unionByName(contained).unionByName(last)


def label_links(labels: DataFrame, figures: DataFrame, keys: list[str]) -> DataFrame:
    """Label key to figure key of the same document, else to the base figure (``fig2a`` -> ``fig2``).

    ``labels(*keys, label_key, ...)``, ``figures(*keys, figure_key, ...)``; figures are unique on their key.
    """
    exact = figures.select(*keys, F.col("figure_key").alias("label_key"), F.lit(True).alias("__exact"))
    base = figures.select(*keys, F.col("figure_key").alias("__base_key"), F.lit(True).alias("__base"))
    joined = (
        labels.withColumn("__base_key", figure_base_key(F.col("label_key")))
        .join(exact, [*keys, "label_key"], "left")
        .join(base, [*keys, "__base_key"], "left")
    )
    matched = F.when(F.col("__exact"), F.col("label_key")).when(F.col("__base"), F.col("__base_key"))
    return joined.withColumn("figure_key", matched).drop("__exact", "__base", "__base_key")


# File types of figure images.
IMAGE_EXTENSIONS = (".jpg", ".jpeg", ".png", ".gif", ".tif", ".tiff", ".webp")


def with_file_parts(files: DataFrame, path: str, prefix: str) -> DataFrame:
    """Adds lower-case file name, stem and extension of a path column."""
    name = F.lower(F.element_at(F.split(F.coalesce(path, F.lit("")), "/"), -1))
    return files.withColumn(f"{prefix}_name", name).withColumns(
        {
            f"{prefix}_stem": F.regexp_replace(f"{prefix}_name", r"(?<=.)\.[^.]+$", ""),
            f"{prefix}_ext": F.regexp_extract(f"{prefix}_name", r".(\.[^.]+)$", 1),
        }
    )


def match_assets(references: DataFrame, files: DataFrame, keys: list[str], ref: str = "href", path: str = "path") -> DataFrame:
    """Best cached image for each reference of the same paper: same name, else same stem, else one stem inside the other."""
    wanted = with_file_parts(references.where(F.col(ref) != ""), ref, "ref")
    have = with_file_parts(files, path, "file")
    have = have.where(~F.col("file_name").startswith("_") & F.col("file_ext").isin(*IMAGE_EXTENSIONS))
    tier = (
        F.when(F.col("file_name") == F.col("ref_name"), 1)
        .when(F.col("file_stem") == F.col("ref_stem"), 2)
        .when(F.contains("file_stem", "ref_stem") | F.contains("ref_stem", "file_stem"), 3)
    )
    matched = wanted.join(have, keys).withColumn("tier", tier).where("tier IS NOT NULL")
    return best_per_key(matched, [*keys, ref], [F.asc("tier"), F.asc(path)]).select(*keys, ref, path, "tier")


def pick_artifact(files: DataFrame, keys: list[str], path: str = "path", size: str = "size") -> DataFrame:
    """Layout artifact of each document: by file name rank, then the largest, then the last path."""
    name = F.lower(F.element_at(F.split(path, "/"), -1))
    rank = (
        F.when(name.endswith("_middle.json"), 4)
        .when(name == "middle.json", 3)
        .when(name == "layout.json", 2)
        .when(name.endswith("layout.json"), 1)
    )
    ranked = files.withColumn("__rank", rank).where("__rank IS NOT NULL")
    best = F.max_by(F.struct(path, "__rank", size), F.struct("__rank", size, path)).alias("__best")
    return ranked.groupBy(*keys).agg(best).select(
        *keys, F.col(f"__best.{path}").alias("picked_path"), F.col("__best.__rank").alias("name_rank")
    )


def prefer_source(primary: DataFrame, fallback: DataFrame, doc: str) -> DataFrame:
    """Rows of the first source for documents it covers, of the second source for all others."""
    rest = fallback.join(primary.select(doc), doc, "left_anti")
    return primary.withColumn("engine", F.lit("primary")).unionByName(rest.withColumn("engine", F.lit("fallback")))
