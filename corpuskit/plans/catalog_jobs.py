"""Catalogue: accounting, inference preparation, exports and streams."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuskit.operators import records, requests, usage
from corpuskit.operators.keyed import dedupe_first
from corpuskit.plans.registry import query
from corpuskit.session import shared_folder
from corpuskit.sources.tables import table
from corpuskit.streaming import ingest, ledger


def _results(spark, folder):
    """Usage rows from the events: tokens, model and tier derived from the columns."""
    k = F.get_json_object("props", "$.k").cast("bigint")
    return table(spark, folder, "events").select(
        "user_id",
        "ts",
        k.alias("input_tokens"),
        F.when(F.col("event_type") != "signup", F.floor("value").cast("bigint")).alias("output_tokens"),
        F.lit(1).alias("num_model_requests"),
        F.when(F.col("event_type") == "view", F.lit(" Click-mini")).otherwise(F.col("event_type")).alias("model"),
        F.when((F.col("user_id") % 3 == 0) & (F.col("event_type") == "error"), "Data Sharing")
        .when((F.col("user_id") % 3 == 1) & (F.col("event_type") == "click"), "complimentary-daily")
        .when(F.col("user_id") % 2 == 0, "default")
        .otherwise("")
        .alias("service_tier"),
    )


_RESULTS_SQL = """
    WITH r AS (
      SELECT user_id, ts, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS i, CASE WHEN event_type <> 'signup' THEN CAST(floor(value) AS BIGINT) ELSE 0 END AS o,
        CASE WHEN event_type = 'view' THEN ' Click-mini' ELSE event_type END AS model,
        CASE WHEN user_id % 3 = 0 AND event_type = 'error' THEN 'Data Sharing' WHEN user_id % 3 = 1 AND event_type = 'click' THEN 'complimentary-daily' WHEN user_id % 2 = 0 THEN 'default' ELSE '' END AS tier,
        event_type IN ('view', 'click', 'purchase') AS eligible,
        (user_id % 3 = 0 AND event_type = 'error') OR (user_id % 3 = 1 AND event_type = 'click') AS incentive
      FROM events)
"""


@query(
    _RESULTS_SQL
    + """
    , a AS (
      SELECT user_id, CAST(sum(i) AS BIGINT) AS total_input_tokens, CAST(sum(o) AS BIGINT) AS total_output_tokens, CAST(sum(i + o) AS BIGINT) AS total_tokens, count(*) AS total_requests,
        CAST(sum(CASE WHEN eligible THEN i + o ELSE 0 END) AS BIGINT) AS eligible_group_tokens, CAST(sum(CASE WHEN eligible THEN 1 ELSE 0 END) AS BIGINT) AS eligible_group_requests,
        CAST(sum(CASE WHEN eligible AND incentive THEN i + o ELSE 0 END) AS BIGINT) AS inc, bool_or(incentive) AS incentive_tier_visible,
        coalesce(string_agg(DISTINCT nullif(tier, ''), ',' ORDER BY nullif(tier, '')), '') AS service_tiers, string_agg(DISTINCT model, ',' ORDER BY model) AS models, count(*) AS n_rows
      FROM r GROUP BY 1)
    SELECT * EXCLUDE (inc), incentive_tier_visible AS complimentary_exact, CASE WHEN incentive_tier_visible THEN inc ELSE eligible_group_tokens END AS complimentary_used_tokens,
      greatest(3000 - CASE WHEN incentive_tier_visible THEN inc ELSE eligible_group_tokens END, 0) AS complimentary_remaining_tokens,
      CASE WHEN incentive_tier_visible THEN 'official incentive service tier' ELSE 'official eligible-model usage fallback' END AS complimentary_source
    FROM a
    """
)
def usage_rollup(spark, folder):
    rolled = usage.usage_rollup(_results(spark, folder), ("click", "purchase"), budget=3000, by=["user_id"])
    return rolled.withColumns({c: F.array_join(c, ",") for c in ("service_tiers", "models")})


@query(
    """
    SELECT o_orderpriority, CAST(sum(CASE WHEN o_orderstatus IN ('P', 'F') THEN CAST(o_totalprice AS DECIMAL(18, 6)) ELSE 0 END) AS DOUBLE) AS cost_usd, count(*) AS cost_rows, 'eur,usd' AS currencies
    FROM orders GROUP BY 1
    """
)
def cost_rollup(spark, folder):
    currency = F.when(F.col("o_orderstatus") == "P", "USD").when(F.col("o_orderstatus") == "O", "eur").otherwise("")
    rows = table(spark, folder, "orders").select("o_orderpriority", currency.alias("currency"), F.col("o_totalprice").alias("value"))
    rolled = usage.cost_rollup(rows, by=["o_orderpriority"])
    return rolled.withColumns({"cost_usd": F.col("cost_usd").cast("double"), "currencies": F.array_join("currencies", ",")})


@query(
    """
    WITH b AS (SELECT user_id, list({'i': CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT), 'n': 1}) AS l FROM events GROUP BY 1)
    SELECT CAST(sum(x.i) AS BIGINT) AS total_input_tokens, count(*) AS n_rows FROM (SELECT unnest(l) AS x FROM b)
    """
)
def payload_totals(spark, folder):
    """Nested usage payloads, one bucket per event, exploded and summed."""
    result = F.struct(
        F.get_json_object("props", "$.k").cast("bigint").alias("input_tokens"), F.lit(None).cast("bigint").alias("output_tokens"),
        F.lit(1).alias("num_model_requests"), F.col("event_type").alias("model"), F.lit("").alias("service_tier"),
    )
    payloads = table(spark, folder, "events").select(F.array(F.struct(F.array(result).alias("results"))).alias("data"))
    rolled = usage.usage_rollup(usage.payload_results(payloads), ("click",), budget=0)
    return rolled.select("total_input_tokens", "n_rows")


def _calls(spark, folder):
    return _results(spark, folder).select(
        "ts", F.trim("model").alias("model"), "input_tokens", F.coalesce("output_tokens", F.lit(0)).alias("output_tokens")
    ).withColumn("total_tokens", F.col("input_tokens") + F.col("output_tokens"))


_LEDGER_SQL = _RESULTS_SQL + """
    , g AS (SELECT CAST(ts AS DATE) AS day, trim(model) AS model, CAST(sum(i) AS BIGINT) AS input_tokens, CAST(sum(o) AS BIGINT) AS output_tokens, CAST(sum(i + o) AS BIGINT) AS total_tokens, count(*) AS calls FROM r GROUP BY ALL)
"""


@query(_LEDGER_SQL + "SELECT strftime(day, '%Y-%m-%d') AS day, * EXCLUDE (day) FROM g")
def daily_ledger(spark, folder):
    return usage.daily_ledger(_calls(spark, folder), "ts", ["model"]).withColumn("day", F.col("day").cast("string"))


@query(_LEDGER_SQL + "SELECT strftime(day, '%Y-%m-%d') AS day, string_agg(model || ':' || calls, ',' ORDER BY model) AS models FROM g GROUP BY day")
def ledger_by_model(spark, folder):
    """Call counts per day as a map over models."""
    daily = usage.daily_ledger(_calls(spark, folder), "ts", ["model"])
    maps = usage.ledger_maps(daily, [], "model", "models")
    shown = F.array_join(F.transform(F.map_entries("models"), lambda e: F.concat(e["key"], F.lit(":"), e["value"])), ",")
    return maps.select(F.col("day").cast("string").alias("day"), shown.alias("models"))


@query(
    _LEDGER_SQL
    + """SELECT CAST(coalesce(sum(input_tokens), 0) AS BIGINT) AS input_tokens, CAST(coalesce(sum(output_tokens), 0) AS BIGINT) AS output_tokens,
         CAST(coalesce(sum(total_tokens), 0) AS BIGINT) AS total_tokens, CAST(coalesce(sum(calls), 0) AS BIGINT) AS calls FROM g WHERE day = DATE '2024-01-05'"""
)
def ledger_today(spark, folder):
    return usage.ledger_day(usage.daily_ledger(_calls(spark, folder), "ts", ["model"]), "2024-01-05")


# --- inference preparation -----------------------------------------------------------------------------------------


@query(
    r"""
    WITH t AS (SELECT doc_id, source, lang, regexp_replace(regexp_replace(text, '^\s+', ''), '\s+$', '') AS t FROM documents),
    p AS (SELECT doc_id, 'Read it.' || chr(10) || chr(10) || 'POSSIBLE METHODS' || chr(10) || source || ', ' || lang || chr(10) || chr(10) || 'CORE ANALYSIS' || chr(10)
      || CASE WHEN lang = 'fr' THEN '{}' ELSE '{"lang":"' || lang || '"}' END || chr(10) || chr(10) || 'PAPER TEXT' || chr(10)
      || substr(t, part * 5000 + 1, 5000) AS prompt, part, n_parts
      FROM (SELECT *, greatest(CAST(ceil(length(t) / 5000) AS INT), 1) AS n_parts FROM t), LATERAL (SELECT unnest(range(n_parts)) AS part))
    SELECT doc_id, 'core' AS stage, CAST(part AS INT) AS part, n_parts, sha256('core|' || doc_id || '|' || part || '|' || prompt) AS request_id, sha256(prompt) AS prompt_hash, length(prompt) AS n_chars FROM p
    """
)
def build_requests(spark, folder):
    core = F.when(F.col("lang") != "fr", F.to_json(F.struct("lang")))
    papers = table(spark, folder, "documents").withColumns({"hints": F.array("source", "lang"), "core": core})
    rows = requests.build_requests(papers, "core", "doc_id", "Read it.", text_chars=5000, core="core", hints="hints")
    return rows.select(
        "doc_id", "stage", "part", "n_parts", "request_id", F.sha2("prompt", 256).alias("prompt_hash"), F.col("n_chars").cast("bigint").alias("n_chars")
    )


@query(
    r"""
    WITH p AS (SELECT item_id, 'Explain.' || chr(10) || chr(10) || 'CORE ANALYSIS' || chr(10) || '{}' || chr(10) || chr(10) || 'TARGET FIGURE' || chr(10) || 'Fig. ' || item_id
      || chr(10) || chr(10) || 'ORIGINAL LEGEND' || chr(10) || CASE WHEN item_id % 4 = 0 THEN 'No legend was extracted.' ELSE text END AS prompt FROM benchmark)
    SELECT item_id, sha256('single_figure|' || item_id || '|Fig. ' || item_id || '|' || prompt) AS request_id, length(prompt) AS n_chars FROM p
    """
)
def figure_requests(spark, folder):
    caption = F.when(F.col("item_id") % 4 == 0, " ").otherwise(F.col("text"))
    figures = table(spark, folder, "benchmark").select(
        "item_id", F.concat(F.lit("Fig. "), "item_id").alias("figure_label"), caption.alias("caption"), F.lit("").alias("core")
    )
    rows = requests.figure_requests(figures, "item_id", "Explain.", "core")
    return rows.select("item_id", "request_id", F.col("n_chars").cast("bigint").alias("n_chars"))


@query(
    """
    WITH d AS (SELECT p_brand, p_name, min(p_partkey) AS pos FROM part GROUP BY ALL),
    n AS (SELECT p_brand, CASE WHEN pos % 2 = 0 THEN upper(p_name) ELSE p_name END AS t, row_number() OVER (PARTITION BY p_brand ORDER BY pos) AS no FROM d)
    SELECT p_brand, (no - 1) // 8 AS batch_no, string_agg(t, '|' ORDER BY no) AS terms, CAST(count(*) AS INT) AS n_terms FROM n GROUP BY ALL
    """
)
def batch_terms(spark, folder):
    spelled = F.when(F.col("p_partkey") % 2 == 0, F.upper("p_name")).otherwise(F.concat(F.lit(" "), F.col("p_name"), F.lit("  ")))
    terms = table(spark, folder, "part").select("p_brand", spelled.alias("term"), "p_partkey")
    batches = requests.batch_terms(terms, "p_brand", "term", "p_partkey", F.floor(F.col("p_partkey") / 1024))
    return batches.withColumn("terms", F.array_join("terms", "|"))


@query(
    """
    WITH k AS (SELECT event_id, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k FROM events)
    SELECT event_id, CASE WHEN event_id % 5 = 0 OR event_id % 5 = 4 THEN 'ok' ELSE 'quarantine' END AS side, CASE WHEN event_id % 5 = 0 OR event_id % 5 = 4 THEN k END AS k,
      CASE WHEN event_id % 5 = 4 THEN 'x,y' END AS tags FROM k
    """
)
def parse_responses(spark, folder):
    """Typed responses; wrong types, missing required fields and text that is no JSON go to quarantine."""
    k, kind = F.get_json_object("props", "$.k"), F.col("event_id") % 5
    body = (
        F.when(kind == 0, F.col("props"))
        .when(kind == 1, F.lit('{"k": "many"}'))
        .when(kind == 2, F.lit("not json"))
        .when(kind == 3, F.lit('{"tags": ["x"]}'))
        .otherwise(F.concat(F.lit('{"k": '), k, F.lit(', "tags": ["x", "y"]}')))
    )
    schema = T.StructType([T.StructField("k", T.IntegerType(), False), T.StructField("tags", T.ArrayType(T.StringType()))])
    good, bad = requests.parse_responses(table(spark, folder, "events").select("event_id", body.alias("body")), schema, "body")
    ok = good.select("event_id", F.lit("ok").alias("side"), "parsed.k", F.array_join("parsed.tags", ",").alias("tags"))
    rejected = bad.select("event_id", F.lit("quarantine").alias("side"), F.lit(None).cast("int").alias("k"), F.lit(None).cast("string").alias("tags"))
    return ok.unionByName(rejected)


@query(
    """
    SELECT event_id, CASE event_type WHEN 'error' THEN 'transient' WHEN 'click' THEN 'model_unavailable' WHEN 'view' THEN 'model_unavailable' WHEN 'purchase' THEN 'transient' ELSE 'other' END AS error_class
    FROM events
    """
)
def error_classes(spark, folder):
    kinds = {
        "error": "HTTP 503 from host", "click": "Model m is NOT AVAILABLE here", "view": "not_found", "purchase": "404: Rate Limit", "signup": "quota exceeded",
    }
    message = F.create_map(*[F.lit(x) for pair in kinds.items() for x in pair])[F.col("event_type")]
    return table(spark, folder, "events").select("event_id", requests.error_class(message).alias("error_class"))


@query(
    """
    WITH d AS (SELECT l_orderkey, l_linenumber, l_partkey, l_returnflag FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_returnflag) = 1)
    SELECT l_orderkey, '{"l_orderkey":' || l_orderkey || ',"modules":{' || string_agg('"' || l_linenumber || '":{"l_partkey":' || l_partkey || ',"l_returnflag":"' || l_returnflag || '"}', ',' ORDER BY l_linenumber) || '}}' AS record
    FROM d GROUP BY 1
    """
)
def export_order_json(spark, folder):
    """All lines of an order as one JSON record."""
    lines = table(spark, folder, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("string").alias("stage"), "l_partkey", "l_returnflag")
    unique = dedupe_first(lines, ["l_orderkey", "stage"], ["l_partkey", "l_returnflag"])
    return records.export_records(unique, "l_orderkey", "stage", ["l_partkey", "l_returnflag"])


@query(
    """
    SELECT conv_id, turn, CASE WHEN role = 'user' THEN text ELSE 'whole ' || role END AS shown FROM conversations
    """
)
def language_branches(spark, folder):
    """Language branch of a bilingual record, else the single-language record."""
    data = F.struct(F.lit(None).cast("struct<text: string>").alias("ko"), F.when(F.col("role") == "user", F.struct("text")).alias("en"))
    whole = F.struct(F.concat(F.lit("whole "), "role").alias("text"))
    rows = table(spark, folder, "conversations").select("conv_id", "turn", data.alias("data"), whole.alias("whole"))
    branch = records.language_branch("data", "en", ["ko", "en"], "whole")
    return rows.select("conv_id", "turn", branch["text"].alias("shown"))


# --- streams -------------------------------------------------------------------------------------------------------


def _stream(spark, folder, name):
    # a glob, because a plain path must be a folder for the file source
    schema = table(spark, folder, name).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1000).parquet(f"{folder}/{name}.parquet*")


@query(_LEDGER_SQL + "SELECT strftime(day, '%Y-%m-%d') AS day, * EXCLUDE (day) FROM g")
def stream_ledger(spark, folder):
    """The daily ledger kept by a stream; must equal the batch ledger."""
    k = F.get_json_object("props", "$.k").cast("bigint")
    out = F.when(F.col("event_type") != "signup", F.floor("value").cast("bigint")).otherwise(0)
    model = F.when(F.col("event_type") == "view", "Click-mini").otherwise(F.col("event_type"))
    calls = _stream(spark, folder, "events").select(
        "ts", model.alias("model"), k.alias("input_tokens"), out.alias("output_tokens"), (k + out).alias("total_tokens")
    )
    state, check = shared_folder(spark, "ledger-state"), shared_folder(spark, "ledger-checkpoint")
    ledger.start_ledger(calls, ["model"], state, check).awaitTermination()
    return ledger.read_ledger(spark, state, ["model"]).withColumn("day", F.col("day").cast("string"))


@query(
    _LEDGER_SQL
    + """SELECT strftime(day, '%Y-%m-%d') AS day, * EXCLUDE (day) FROM g"""
)
def stream_ledger_watermark(spark, folder):
    """The ledger that keeps late calls apart, over calls without totals; the one batch of the table has no late ones, so it must equal the batch ledger."""
    k = F.get_json_object("props", "$.k").cast("bigint")
    out = F.when(F.col("event_type") != "signup", F.floor("value").cast("bigint")).otherwise(0)
    model = F.when(F.col("event_type") == "view", "Click-mini").otherwise(F.col("event_type"))
    calls = _stream(spark, folder, "events").select(
        F.col("ts").cast("timestamp").alias("ts"), model.alias("model"), k.alias("input_tokens"), out.alias("output_tokens"), F.lit(None).cast("bigint").alias("total_tokens")
    )
    state, check = shared_folder(spark, "late-ledger-state"), shared_folder(spark, "late-ledger-checkpoint")
    ledger.start_late_ledger(calls, ["model"], state, check, "1 day").awaitTermination()
    return ledger.read_late_ledger(spark, state, ["model"]).withColumn("day", F.col("day").cast("string"))


@query(
    """
    SELECT lower(p_name) AS normalized_name, min(p_partkey) AS pos, arg_min(p_brand, p_partkey) AS brand FROM part WHERE lower(p_name) NOT IN (SELECT lower(p_name) FROM part WHERE p_type = 'PROMO' AND p_size = 1) GROUP BY 1
    """
)
def stream_archive(spark, folder):
    """Concepts that a stream added to an archive: each once, stored ones never."""
    base = table(spark, folder, "part").where("p_type = 'PROMO' AND p_size = 1").select(F.lower("p_name").alias("normalized_name"))
    rows = _stream(spark, folder, "part").select(F.lower("p_name").alias("normalized_name"), F.col("p_partkey").alias("pos"), F.col("p_brand").alias("brand"))
    archive = ingest.open_archive(spark, shared_folder(spark, "archive-state"), "normalized_name string, pos bigint, brand string", "normalized_name", base)
    ingest.start_ingest(rows, archive, ["pos"], shared_folder(spark, "archive-checkpoint")).awaitTermination()
    return ingest.read_added(archive)


@query(_LEDGER_SQL + """SELECT strftime(day, '%Y-%m-%d') AS day, * EXCLUDE (day) FROM g""")
def stream_ledger_window(spark, folder):
    """The ledger as event-time windows behind a watermark, upserted into a bucketed table; no call of the table is later than the delay."""
    k = F.get_json_object("props", "$.k").cast("bigint")
    out = F.when(F.col("event_type") != "signup", F.floor("value").cast("bigint")).otherwise(0)
    model = F.when(F.col("event_type") == "view", "Click-mini").otherwise(F.col("event_type"))
    calls = _stream(spark, folder, "events").select(
        F.col("ts").cast("timestamp").alias("ts"), model.alias("model"), k.alias("input_tokens"), out.alias("output_tokens"), (k + out).alias("total_tokens")
    )
    days = ledger.window_table(spark, shared_folder(spark, "window-ledger"), ["model"])
    ledger.start_window_ledger(calls, ["model"], days, shared_folder(spark, "window-checkpoint"), "40 days").awaitTermination()
    return days.read().withColumn("day", F.col("day").cast("string"))
