"""Canonical identity of document files and the roll-up of files to entities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuskit.functions.text import (
    SUPPLEMENT_MARKERS,
    clean_doi,
    contains_any,
    fold,
    normalize_title,
    strip,
    text_or_empty,
)

# Identifier shapes, and what makes a title credible.
DOI = r"(?i)10\.\d{4,9}/[-._;()/:A-Z0-9]+"
PMCID = r"(?i)\bPMC\d{5,10}\b"
PMID = r"(?i)\bPMID\s*[:#]?\s*(\d{5,10})\b"
YEAR = r"\b(19\d{2}|20\d{2})\b"
MIN_TITLE_CHARS, MIN_TITLE_WORDS = 35, 5
IDENTITY_FIELDS = (
    "canonical_key", "identity_type", "identity_value", "confidence", "document_kind", "doi", "pmcid", "pmid", "title", "normalized_title",
    "publication_year",
)
# What names a supplement opens the text or stands alone on its line, perhaps numbered or with a colon.
SUPPLEMENT_LINE = rf"(?i)\A\s*(?:{'|'.join(SUPPLEMENT_MARKERS)})\b|"
SUPPLEMENT_LINE += rf"(?m)^[^\S\n]*(?:s?\d+[.:]?[^\S\n]+)?(?:{'|'.join(SUPPLEMENT_MARKERS)})[^\S\n]*[.:]?[^\S\n]*$"


def publication_year(text: Column, title: Column, filename: Column, as_of_year: int) -> Column:
    """First year word that is not later than next year, searched in text, title, file name."""
    blob = F.concat_ws("\n", text, title, filename)
    years = F.transform(F.regexp_extract_all(blob, F.lit(YEAR), F.lit(1)), lambda y: y.cast("int"))
    return F.try_element_at(F.filter(years, lambda y: y <= as_of_year + 1), F.lit(1))


def document_kind(title: Column, filename: Column, text: Column) -> Column:
    """Supplement if title or file name say so, the text opens with it, or a line is nothing but such a heading.  Mentions inside prose don't count."""
    named = contains_any(F.translate(fold(F.concat_ws(" ", title, filename)), "_-", "  "), SUPPLEMENT_MARKERS)
    return F.when(named | text.rlike(SUPPLEMENT_LINE), "supplement").otherwise("main")


def is_credible_title(normalized: Column) -> Column:
    return (F.length(normalized) >= MIN_TITLE_CHARS) & (F.size(F.split(normalized, " ")) >= MIN_TITLE_WORDS)


def resolve_identity(
    files: DataFrame, as_of_year: int, unicode: bool = True
) -> DataFrame:
    """Identity of each file: DOI, else PMCID, else PMID, else credible title and year, else the file hash.

    Input columns ``text, title, filename, file_hash``; they are kept except for ``text`` and ``title`` is normalised to
    non-null.  Supplements get their own key.  One projection chain without a shuffle; whole texts
    are searched, only where a cheap literal says that a search can succeed, and only titles go through an Arrow UDF (unless not ``unicode``).
    """
    text = text_or_empty("text")
    found = files.withColumns(
        {
            "title": strip("title"),
            "__doi": F.when(text.contains("10."), F.regexp_extract(text, DOI, 0)).otherwise(""),
            "__pmcid": F.when(text.rlike("(?i)pmc"), F.upper(F.regexp_extract(text, PMCID, 0))).otherwise(""),
            "__pmid": F.when(text.rlike("(?i)pmid"), F.regexp_extract(text, PMID, 1)).otherwise(""),
            "publication_year": publication_year(text, text_or_empty("title"), text_or_empty("filename"), as_of_year),
            "document_kind": document_kind(text_or_empty("title"), text_or_empty("filename"), text),
        }
    ).drop("text")
    found = found.withColumns({"__doi": clean_doi("__doi"), "normalized_title": normalize_title("title", unicode)})
    titled = is_credible_title(F.col("normalized_title")) & F.col("publication_year").isNotNull()
    found = found.withColumn(
        "identity_type",
        F.when(F.col("__doi") != "", "doi")
        .when(F.col("__pmcid") != "", "pmcid")
        .when(F.col("__pmid") != "", "pmid")
        .when(titled, "title_year")
        .otherwise("sha256"),
    )
    kind = F.col("identity_type")
    year = F.col("publication_year").cast("string")
    digest = F.left(F.sha2("normalized_title", 256), F.lit(24))
    value = (
        F.when(kind == "doi", F.col("__doi"))
        .when(kind == "pmcid", F.col("__pmcid"))
        .when(kind == "pmid", F.col("__pmid"))
        .when(kind == "title_year", F.concat("title", F.lit(" ("), year, F.lit(")")))
        .otherwise(F.col("file_hash"))
    )
    base = F.when(kind == "title_year", F.concat(F.lit("titleyear:"), year, F.lit(":"), digest)).otherwise(
        F.concat(kind, F.lit(":"), value)
    )
    suffix = F.when((kind != "sha256") & (F.col("document_kind") != "main"), F.concat(F.lit(":"), "document_kind"))
    confidence = F.when(kind.isin("doi", "pmcid", "pmid"), "high").when(kind == "title_year", "medium")
    out = found.withColumns(
        {
            "identity_value": value,
            "canonical_key": F.concat(base, F.coalesce(suffix, F.lit(""))),
            "confidence": F.coalesce(confidence, F.lit("exact_file_only")),
            "doi": F.when(kind == "doi", F.col("__doi")).otherwise(""),
            "pmcid": F.when(kind == "pmcid", F.col("__pmcid")).otherwise(""),
            "pmid": F.when(kind == "pmid", F.col("__pmid")).otherwise(""),
        }
    )
    carried = [c for c in files.columns if c not in ("text", "title")]
    return out.select(*carried, *IDENTITY_FIELDS)


def entity_rollup(files: DataFrame, key: str, seen: str, attributes: list[str], tie: str) -> DataFrame:
    """Files to entities: attributes of the last file seen, first and last sighting, number of files.

    ``has_conflict`` tells that files under one key disagree in the first attribute (a cited identifier may have been taken
    for the file's own).
    """
    first = attributes[0]
    rolled = files.groupBy(key).agg(
        F.min(seen).alias("first_seen_at"),
        F.max(seen).alias("last_seen_at"),
        F.count("*").alias("n_files"),
        F.max_by(F.struct(*attributes), F.struct(seen, tie)).alias("__attr"),
        (F.min(first) != F.max(first)).alias("has_conflict"),
    )
    return rolled.select(key, "__attr.*", "first_seen_at", "last_seen_at", "n_files", "has_conflict")
