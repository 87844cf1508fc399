"""Offline inference: request rows, term batches, typed responses, error classes.  The model calls are not part of it."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuskit.functions.text import clean_concept, compact_text, contains_any, let, text_or_empty
from corpuskit.operators.keyed import dedupe_first
from corpuskit.operators.ordered import number_rows

# How many characters of text a request of a stage carries; a longer text becomes several requests.
TEXT_CHARS = {
    "core": 135_000,
    "prerequisites": 100_000,
    "experiments": 125_000,
    "figures": 125_000,
    "critical_learning": 105_000,
}
CONCEPTS_PER_REQUEST = 8
TRANSIENT_MARKERS = (
    "429", "rate limit", "500", "502", "503", "504", "temporarily", "timeout", "internal", "unavailable",
)


def text_parts(text: str, max_chars: Column | int) -> Column:
    """(part, n_parts, body) of a paper's text without its reference list: consecutive slices of at most ``max_chars`` characters."""
    limit = F.lit(max_chars) if isinstance(max_chars, int) else max_chars

    def cut(body: Column) -> Column:
        n = F.greatest(F.ceil(F.length(body) / limit).cast("int"), F.lit(1))
        return F.transform(
            F.sequence(F.lit(0), n - 1),
            lambda i: F.struct(i.alias("part"), n.alias("n_parts"), F.substring(body, i * limit + 1, limit).alias("body")),
        )

    return let(compact_text(text), cut)


def prompt(instruction: Column, body: Column, core: str | None = None, hints: str | None = None, experiments: str | None = None) -> Column:
    """Prompt of one stage: instruction, hints, core analysis, experiments and one part of the text.  Nothing is cut."""
    parts = [instruction]
    if hints:
        parts.append(F.concat(F.lit("POSSIBLE METHODS\n"), F.coalesce(F.nullif(F.array_join(F.col(hints), ", "), F.lit("")), F.lit("none"))))
    if core:
        parts.append(F.concat(F.lit("CORE ANALYSIS\n"), F.coalesce(F.nullif(text_or_empty(core), F.lit("")), F.lit("{}"))))
    if experiments:
        parts.append(F.concat(F.lit("EXPERIMENTS\n"), text_or_empty(experiments)))
    parts.append(F.concat(F.lit("PAPER TEXT\n"), body))
    return F.concat_ws("\n\n", *parts)


def build_stage_requests(work: DataFrame, key: str, instructions: Mapping[str, str], text_chars: Mapping[str, int] = TEXT_CHARS, text: str = "text", **columns: str) -> DataFrame:
    """Request rows of several stages in one pass: ``work`` holds a ``stage`` column, each row builds the prompts of its stage.

    A text longer than its stage allows becomes several requests, numbered from 0 in ``part`` of ``n_parts``; together they hold the whole text.
    ``columns`` name the core, hints and experiments columns.  The digest that is the id makes a repeated run yield the same ids.
    """
    wanted = work.where(F.col("stage").isin(*instructions))
    instruction, limit = F.lit(None).cast("string"), F.lit(None).cast("int")
    for stage, said in instructions.items():
        instruction = F.when(F.col("stage") == stage, F.lit(said)).otherwise(instruction)
        limit = F.when(F.col("stage") == stage, F.lit(text_chars[stage])).otherwise(limit)
    kept = [c for c in (*columns.values(),) if c]
    rows = wanted.select(key, "stage", *kept, instruction.alias("__said"), F.explode(text_parts(text, limit)).alias("__p"))
    built = rows.select(F.col(key), "stage", F.col("__p.part").alias("part"), F.col("__p.n_parts").alias("n_parts"), prompt(F.col("__said"), F.col("__p.body"), **columns).alias("prompt"))
    digest = F.sha2(F.concat_ws("|", "stage", F.col(key).cast("string"), F.col("part").cast("string"), "prompt"), 256)
    return built.select(digest.alias("request_id"), key, "stage", "part", "n_parts", "prompt", F.length("prompt").alias("n_chars"))


def build_requests(papers: DataFrame, stage: str, key: str, instruction: str, text_chars: int | None = None, **columns: str) -> DataFrame:
    """Request rows of one stage; see ``build_stage_requests``."""
    work = papers.withColumn("stage", F.lit(stage))
    return build_stage_requests(work, key, {stage: instruction}, {stage: text_chars or TEXT_CHARS[stage]}, **columns)


def figure_requests(figures: DataFrame, key: str, instruction: str, core: str) -> DataFrame:
    """One request row per figure: label, whole legend and the whole core analysis of its paper."""
    body = F.concat_ws(
        "\n\n",
        F.lit(instruction),
        F.concat(F.lit("CORE ANALYSIS\n"), F.coalesce(F.nullif(text_or_empty(core), F.lit("")), F.lit("{}"))),
        F.concat(F.lit("TARGET FIGURE\n"), F.trim(text_or_empty("figure_label"))),
        F.concat(F.lit("ORIGINAL LEGEND\n"), F.coalesce(F.nullif(F.trim(text_or_empty("caption")), F.lit("")), F.lit("No legend was extracted."))),
    )
    rows = figures.select(key, "figure_label", body.alias("prompt"))
    digest = F.sha2(F.concat_ws("|", F.lit("single_figure"), F.col(key).cast("string"), "figure_label", "prompt"), 256)
    return rows.select(digest.alias("request_id"), key, F.lit("single_figure").alias("stage"), "prompt", F.length("prompt").alias("n_chars"))


def batch_terms(terms: DataFrame, key: str, term: str, position: str, bucket: Column) -> DataFrame:
    """Distinct terms of a request in order, at most eight per batch.

    Input rows are (key, term, position).  Longer lists become several batches; the batch is the largest group collected.
    """
    cleaned = terms.select(key, F.trim(term).alias("__t"), position).where("__t != ''")
    cleaned = cleaned.withColumn("__norm", F.lower("__t"))
    distinct = dedupe_first(cleaned, [key, "__norm"], [position])
    numbered = number_rows(distinct, [key], [position], bucket, "__no")
    batched = numbered.withColumn("batch_no", F.floor((F.col("__no") - 1) / CONCEPTS_PER_REQUEST))
    listed = F.array_sort(F.collect_list(F.struct("__no", clean_concept("__t").alias("__t"))))
    out = batched.groupBy(key, "batch_no").agg(listed.alias("__l"))
    return out.select(key, "batch_no", F.col("__l.__t").alias("terms"), F.size("__l").alias("n_terms"))


def parse_responses(responses: DataFrame, schema: T.StructType, body: str) -> tuple[DataFrame, DataFrame]:
    """Typed rows and quarantine: a response is invalid if it is no JSON of the schema's types or lacks a required field."""
    corrupt = "_corrupt_record"
    typed = T.StructType([*schema.fields, T.StructField(corrupt, T.StringType())])
    parsed = responses.withColumn(
        "parsed", F.from_json(body, typed, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": corrupt})
    )
    required = F.lit(True)
    for f in schema.fields:
        if not f.nullable:
            required = required & F.col(f"parsed.{f.name}").isNotNull()
    ok = F.coalesce(F.col("parsed").isNotNull() & F.col(f"parsed.{corrupt}").isNull() & required, F.lit(False))
    marked = parsed.withColumn("__ok", ok)
    good = marked.where("__ok").withColumn("parsed", F.col("parsed").dropFields(corrupt)).drop("__ok")
    return good, marked.where("NOT __ok").drop("__ok", "parsed")


def error_class(message: Column | str) -> Column:
    """transient, model_unavailable or other.  A message of both kinds is transient: it is tried again first."""
    text = F.lower(text_or_empty(message))
    gone = text.contains("404") | text.contains("not_found") | (text.contains("model") & text.contains("not available"))
    return F.when(contains_any(text, TRANSIENT_MARKERS), "transient").when(gone, "model_unavailable").otherwise("other")

