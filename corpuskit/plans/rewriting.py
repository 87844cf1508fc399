"""Plan: texts through an external rewriter (a translator, say) and back, with terms protected.

``plan_rewriting`` decides which texts go, puts placeholders for protected terms, cuts chunks, and stages one row per text.  ``chunk_requests`` lists the distinct chunks to be
rewritten; whoever rewrites them returns a table of answers.  ``apply_answers`` joins these, keeps the source chunk where an answer is missing or is an error
page, gathers the chunks in order and restores the terms.  Equal chunks are asked for once, however many texts hold them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuskit.functions.python_udfs import protect_listed_text, restore_text
from corpuskit.functions.sentences import CHUNK_CHARS, chunk_text
from corpuskit.functions.text import is_error_page, mostly_korean, text_or_empty
from corpuskit.operators.dictionary import mention_pairs
from corpuskit.session import staged


def listed_terms(texts: DataFrame, terms: DataFrame, text_id: str, text: str) -> DataFrame:
    """(text_id, terms): the terms that each text holds, whatever their case; texts without any are left out."""
    folded = terms.select(F.col("term"), F.lower("term").alias("__low")).where(F.length("term") >= 2).distinct()
    held = mention_pairs(texts.select(text_id, F.lower(text).alias("__hay")), folded, text_id, "__hay", "__low")
    return held.groupBy(text_id).agg(F.array_sort(F.collect_set("term")).alias("terms"))


def plan_rewriting(
    texts: DataFrame, terms: DataFrame, text: str = "text", wanted: Column | None = None, done: Column | None = None, max_chars: int = CHUNK_CHARS
) -> DataFrame:
    """All columns of ``texts`` plus ``row_id``, ``protected`` (text, terms) and ``chunks``; texts that stay as they are have no chunks.

    A text stays if it is empty, not ``wanted`` (another language), or ``done`` already (by default: mostly Korean).  ``terms(term)`` is a table of any size.
    """
    done = mostly_korean(text) if done is None else done
    goes = (text_or_empty(text) != "") & ~F.coalesce(done, F.lit(False))
    if wanted is not None:
        goes = goes & F.coalesce(wanted, F.lit(False))
    # written once, so that the row ids are the same for all who read them
    rows = staged(texts.select("*", F.monotonically_increasing_id().alias("row_id"), goes.alias("__goes")), "rewriting-texts")
    going = rows.where("__goes").select("row_id", F.col(text).alias("__text"))
    held = going.join(listed_terms(going, terms, "row_id", "__text"), "row_id", "left")
    none = F.array().cast("array<string>")
    protected = held.select("row_id", protect_listed_text(F.col("__text"), F.coalesce("terms", none)).alias("protected"))
    chunked = protected.withColumn("chunks", chunk_text(F.col("protected.text"), max_chars))
    planned = rows.join(chunked, "row_id", "left").withColumn("chunks", F.coalesce("chunks", none))
    return staged(planned.drop("__goes"), "rewriting-plan")


def chunk_requests(plan: DataFrame) -> DataFrame:
    """(chunk_id, chunk): every distinct chunk once."""
    chunks = plan.select(F.explode("chunks").alias("chunk"))
    return chunks.groupBy(F.sha2("chunk", 256).alias("chunk_id")).agg(F.first("chunk").alias("chunk"))


def apply_answers(plan: DataFrame, answers: DataFrame, text: str = "text") -> DataFrame:
    """The columns of the texts plus ``rewritten``, ``n_chunks`` and ``n_kept``, the number of chunks that stayed as they were for want of a good answer.

    ``answers(chunk_id, answer)`` holds at most one row per chunk.  Texts without chunks are returned as they are.
    """
    parts = plan.select("row_id", F.posexplode("chunks").alias("pos", "chunk")).withColumn("chunk_id", F.sha2("chunk", 256))
    met = parts.join(answers.select("chunk_id", "answer"), "chunk_id", "left")
    bad = is_error_page("answer")
    value = F.when(bad, F.col("chunk")).otherwise(F.col("answer"))
    gathered = met.groupBy("row_id").agg(
        F.array_sort(F.collect_list(F.struct("pos", value.alias("value")))).alias("parts"), F.count("*").alias("n_chunks"), F.count_if(bad).alias("n_kept")
    )
    joined = plan.join(gathered, "row_id", "left")
    whole = restore_text(F.array_join("parts.value", " "), F.col("protected.terms"))
    zero = F.lit(0).cast("bigint")
    return joined.select(
        *[c for c in plan.columns if c not in ("row_id", "protected", "chunks")],
        F.when(F.size("chunks") == 0, F.col(text)).otherwise(whole).alias("rewritten"),
        F.coalesce("n_chunks", zero).alias("n_chunks"),
        F.coalesce("n_kept", zero).alias("n_kept"),
    )
