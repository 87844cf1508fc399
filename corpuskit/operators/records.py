"""Validation, repair, localisation and export of structured records."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuskit.functions.sentences import sentence_points, split_points
from corpuskit.functions.text import strip

# Allowed values of the checked columns, and the fixed sentences of repaired records.
DIFFICULTIES = ("basic", "intermediate", "advanced")
QUALITY_STATUSES = ("AI_GENERATED", "REVIEWED", "CURATED")
KEY_QUESTION = {
    "ko": ("", "은 어떤 생물학적 질문에 답하는 실험인가?", "이 실험은 어떤 생물학적 질문에 답하는가?"),
    "en": ("What biological question does ", " answer?", "What biological question does this method answer?"),
}
INTERPRETATION_TIP = {
    "ko": "이 방법이 직접 측정한 값과 그 값에서 추론한 생물학적 의미를 구분해서 읽는다.",
    "en": "Distinguish the assay's direct measurement from the biological interpretation inferred from it.",
}
ARTICLE_TIP = {
    "ko": "측정값 자체와 그 값에서 추론한 생물학적 의미를 구분해서 읽는다.",
    "en": "Separate what the assay directly measures from the biological interpretation inferred from it.",
}
BEST_FOR_DEFAULT = {
    "ko": "이 방법이 직접 답할 수 있는 질문에 사용한다.",
    "en": "Use it for questions the assay can directly address.",
}
LIMITATION_DEFAULT = {
    "ko": "측정값과 생물학적 인과관계를 동일시하지 않는다.",
    "en": "Do not equate a measured association with biological causality.",
}


def validate(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """Adds ``errors`` (names of the violated rules, in rule order) and ``valid``.  A rule that yields null is violated."""
    failed = F.array_compact(
        F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()])
    )
    return df.withColumn("errors", failed).withColumn("valid", F.size("errors") == 0)


def quarantine(validated: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid rows, rejected rows)."""
    return validated.where("valid").drop("valid", "errors"), validated.where("NOT valid")


def concept_rules() -> dict[str, Column]:
    """Checks of the concept table."""
    return {
        "name": F.coalesce("canonical_name", F.lit("")) != "",
        "difficulty": F.col("difficulty").isin(*DIFFICULTIES),
        "quality_status": F.col("quality_status").isin(*QUALITY_STATUSES),
        "prerequisites": F.col("prerequisites").isNotNull(),
        "hit_count": F.col("hit_count") >= 0,
    }


def filled(*values: Column | str) -> Column:
    """First value that is not blank, stripped; empty if all are."""
    return F.coalesce(*[F.nullif(strip(v), F.lit("")) for v in values], F.lit(""))


def _list_or(given: Column, derived: Column, last: Column) -> Column:
    """Own list, else the derived one, else a one-item list."""
    return (
        F.when(F.coalesce(F.size(given), F.lit(0)) > 0, given).when(F.size(derived) > 0, derived).otherwise(F.array(last))
    )


def repair_method_entries(entries: DataFrame, name: str = "canonical_name", langs: Sequence[str] = ("ko", "en")) -> DataFrame:
    """Entries with every field filled: own value, else points derived from the prose field, else a fixed sentence."""
    out = entries
    title = strip(name)
    for lang in langs:
        def c(field: str, lang: str = lang) -> Column:
            return F.col(f"{field}_{lang}")

        before, after, _ = KEY_QUESTION[lang]
        summary, principle = strip(c("summary")), strip(c("principle"))
        out = out.withColumns(
            {
                f"key_question_{lang}": filled(c("key_question"), F.concat(F.lit(before), title, F.lit(after))),
                f"one_liner_{lang}": filled(c("one_liner"), summary),
                f"principle_steps_{lang}": _list_or(
                    c("principle_steps"), split_points(principle), filled(principle, summary, title)
                ),
                f"best_for_points_{lang}": _list_or(
                    c("best_for_points"), split_points(c("best_for")), filled(c("best_for"), F.lit(BEST_FOR_DEFAULT[lang]))
                ),
                f"limitation_points_{lang}": _list_or(
                    c("limitation_points"), split_points(c("limitations")), filled(c("limitations"), F.lit(LIMITATION_DEFAULT[lang]))
                ),
                f"interpretation_tip_{lang}": filled(c("interpretation_tip"), F.lit(INTERPRETATION_TIP[lang])),
            }
        )
    return out


def stored_points(points: Column, fallback: Column) -> Column:
    """Points as newline-separated text for a table without arrays; the fallback where there are none."""
    kept = F.filter(F.transform(points, strip), lambda p: p != "")
    return F.when(F.coalesce(F.size(kept), F.lit(0)) > 0, F.array_join(kept, "\n")).otherwise(fallback)


def method_article(
    entries: DataFrame, lang: str, name: str = "canonical_name", carried: Sequence[str] = ()
) -> DataFrame:
    """Reading view of stored entries in one language.

    Stored points are separated by newlines, so newlines split as well as sentence ends.
    """
    tail = "ko" if lang == "ko" else "en"
    before, after, plain = KEY_QUESTION[tail]
    title = strip(name)

    def points(field: str) -> Column:
        return sentence_points(F.regexp_replace(F.coalesce(f"{field}_{tail}", F.lit("")), r"\n+", "; "))

    return entries.select(
        *carried,
        name,
        F.when(title == "", F.lit(plain)).otherwise(F.concat(F.lit(before), title, F.lit(after))).alias("key_question"),
        F.coalesce(f"summary_{tail}", F.lit("")).alias("one_liner"),
        points("principle").alias("principle_steps"),
        points("best_for").alias("best_for_points"),
        points("limitations").alias("limitation_points"),
        F.lit(ARTICLE_TIP[tail]).alias("interpretation_tip"),
    )


def language_branch(data: str, lang: str, fields: Sequence[str], whole: str | None = None) -> Column:
    """Language branch of a bilingual struct (``data.ko`` / ``data.en``), else the single-language struct ``whole``."""
    branch = F.col(f"{data}.{lang}") if lang in fields else F.lit(None)
    return F.coalesce(branch, F.col(whole)) if whole else branch


def export_records(stages: DataFrame, key: str, stage: str, payload: Sequence[str], carried: Sequence[str] = ()) -> DataFrame:
    """All stage results of an entity as one JSON record, stages in name order.

    Rows are unique on (key, stage), so a record holds no more entries than there are stages.
    """
    entries = F.array_sort(F.collect_list(F.struct(F.col(stage).alias("key"), F.struct(*payload).alias("value"))))
    grouped = stages.groupBy(key, *carried).agg(F.map_from_entries(entries).alias("modules"))
    return grouped.select(key, F.to_json(F.struct(key, *carried, "modules")).alias("record"))
