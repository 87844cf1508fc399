"""Usage and cost accounting."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Markers of a complimentary service tier, and the assumed daily allowance.
INCENTIVE_MARKERS = ("data sharing", "data_sharing", "data-sharing", "incentive", "complimentary")
DAILY_BUDGET = 2_500_000
EXACT_SOURCE = "official incentive service tier"
FALLBACK_SOURCE = "official eligible-model usage fallback"


def starts_with_any(c: Column, prefixes: Sequence[str]) -> Column:
    name = F.lower(F.trim(F.coalesce(c, F.lit(""))))
    out = F.lit(False)
    for prefix in prefixes:
        out = out | name.startswith(prefix)
    return out


def is_incentive_tier(c: Column, markers: Sequence[str] = INCENTIVE_MARKERS) -> Column:
    tier = F.lower(F.trim(F.coalesce(c, F.lit(""))))
    out = F.lit(False)
    for marker in markers:
        out = out | tier.contains(marker)
    return out


def payload_results(payloads: DataFrame) -> DataFrame:
    """``data[].results[]`` of the payload rows, one row per result."""
    return payloads.select(F.explode("data").alias("__b")).select(F.inline("__b.results"))


def usage_rollup(
    results: DataFrame, eligible_prefixes: Sequence[str], budget: int = DAILY_BUDGET, by: Sequence[str] = ()
) -> DataFrame:
    """Token and request totals, eligible and incentive sums, and what is left of the allowance.

    Used tokens are the incentive sum if any tier is an incentive tier, else the eligible sum; the rest is null without a budget.
    Tiers and models are few, so their sets stay small.
    """
    tokens_in = F.coalesce(F.col("input_tokens").cast("bigint"), F.lit(0))
    tokens_out = F.coalesce(F.col("output_tokens").cast("bigint"), F.lit(0))
    requests = F.coalesce(F.col("num_model_requests").cast("bigint"), F.lit(0))
    rows = results.withColumns(
        {
            "__in": tokens_in,
            "__out": tokens_out,
            "__req": requests,
            "__eligible": starts_with_any(F.col("model"), eligible_prefixes),
            "__incentive": is_incentive_tier(F.col("service_tier")),
        }
    )
    total = F.col("__in") + F.col("__out")

    def only(cond: str, value: Column) -> Column:
        return F.sum(F.when(F.col(cond), value).otherwise(0))

    incentive = F.col("__eligible") & F.col("__incentive")
    out = rows.groupBy(*by).agg(
        F.sum("__in").alias("total_input_tokens"),
        F.sum("__out").alias("total_output_tokens"),
        F.sum(total).alias("total_tokens"),
        F.sum("__req").alias("total_requests"),
        only("__eligible", total).alias("eligible_group_tokens"),
        only("__eligible", F.col("__req")).alias("eligible_group_requests"),
        F.sum(F.when(incentive, total).otherwise(0)).alias("__incentive_tokens"),
        F.bool_or("__incentive").alias("incentive_tier_visible"),
        F.sort_array(F.collect_set(F.nullif("service_tier", F.lit("")))).alias("service_tiers"),
        F.sort_array(F.collect_set(F.nullif("model", F.lit("")))).alias("models"),
        F.count("*").alias("n_rows"),
    )
    visible = F.coalesce("incentive_tier_visible", F.lit(False))
    used = F.when(visible, F.col("__incentive_tokens")).otherwise(F.col("eligible_group_tokens"))
    left = F.greatest(F.lit(budget) - used, F.lit(0)) if budget > 0 else F.lit(None).cast("bigint")
    return out.withColumns(
        {
            "incentive_tier_visible": visible,
            "complimentary_used_tokens": used,
            "complimentary_remaining_tokens": left,
            "complimentary_exact": visible,
            "complimentary_source": F.when(visible, EXACT_SOURCE).otherwise(FALLBACK_SOURCE),
        }
    ).drop("__incentive_tokens")


def cost_rollup(results: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Cost in USD (an empty currency counts as USD), rows and currencies.  Summed as decimals."""
    currency = F.lower(F.coalesce("currency", F.lit("")))
    value = F.coalesce(F.col("value").cast("decimal(18,6)"), F.lit(0).cast("decimal(18,6)"))
    return results.groupBy(*by).agg(
        F.sum(F.when(currency.isin("", "usd"), value).otherwise(F.lit(0).cast("decimal(18,6)"))).alias("cost_usd"),
        F.count("*").alias("cost_rows"),
        F.sort_array(F.collect_set(F.nullif(currency, F.lit("")))).alias("currencies"),
    )


def daily_ledger(calls: DataFrame, ts: str, keys: Sequence[str]) -> DataFrame:
    """Calls and tokens per UTC day and ``keys`` (provider, model, stage)."""
    tokens = F.coalesce("total_tokens", F.col("input_tokens") + F.col("output_tokens"))
    return calls.groupBy(F.to_date(ts).alias("day"), *keys).agg(
        F.sum("input_tokens").alias("input_tokens"),
        F.sum("output_tokens").alias("output_tokens"),
        F.sum(tokens).alias("total_tokens"),
        F.count("*").alias("calls"),
    )


def ledger_maps(ledger: DataFrame, keys: Sequence[str], name: str, out: str) -> DataFrame:
    """Call counts per day as a map ``name -> calls``, built from the aggregated ledger and therefore small."""
    per_name = ledger.groupBy("day", *keys, name).agg(F.sum("calls").alias("calls"))
    entries = F.array_sort(F.collect_list(F.struct(name, "calls")))
    return per_name.groupBy("day", *keys).agg(F.map_from_entries(entries).alias(out))


def ledger_day(ledger: DataFrame, day: str) -> DataFrame:
    """Totals of one day read back from the ledger."""
    return ledger.where(F.col("day") == F.lit(day).cast("date")).agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("input_tokens", "output_tokens", "total_tokens", "calls")]
    )
