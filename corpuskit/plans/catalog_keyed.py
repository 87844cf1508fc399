"""Catalogue: identity of files, keyed tables, concept archive."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuskit.operators import archive, identity, keyed, linking
from corpuskit.plans.registry import query
from corpuskit.session import shared_folder
from corpuskit.sources.buckets import BucketedTable
from corpuskit.sources.tables import table

AS_OF_YEAR = 2025


@query(
    r"""
    WITH f AS (
      SELECT doc_id, sha256(text) AS file_hash, source || '_' || doc_id || '.pdf' AS filename,
        'A Study of ' || source || ' with Many More Words in ' || lang || ' Corpora' AS title,
        text || chr(10) || CASE CAST(doc_id % 6 AS INT)
          WHEN 0 THEN 'see doi:10.1234/' || upper(source) || '(' || doc_id || ')).' || chr(10) || ' S2. Supporting Information:  ' || chr(10) || 'Table'
          WHEN 1 THEN 'as pmc' || (1000000 + doc_id) || ' and PMID: ' || (2000000 + doc_id)
          WHEN 2 THEN 'with PMID# ' || (2000000 + doc_id) || ', Supporting Information, 2031 and 1998'
          WHEN 3 THEN 'published 2150, 2019' WHEN 4 THEN 'see Supplementary Information for details' ELSE 'doi 10.99999/x.' || doc_id || '. The Supplementary material 2026' END AS body
      FROM documents),
    x AS (
      SELECT *, list_filter(list_transform(regexp_extract_all(concat_ws(chr(10), body, title, filename), '\b(19\d{2}|20\d{2})\b'), lambda y: CAST(y AS INT)), lambda y: y <= 2026)[1] AS y,
        CASE WHEN regexp_matches(translate(lower(concat_ws(' ', title, filename)), '_-', '  '), 'supplementary information|supporting information|supplementary material|supplemental material|supplemental information|supporting materials')
          OR regexp_matches(body, '(?i)\A\s*(?:supplementary information|supporting information|supplementary material|supplemental material|supplemental information|supporting materials)\b|(?m)^[^\S\n]*(?:s?\d+[.:]?[^\S\n]+)?(?:supplementary information|supporting information|supplementary material|supplemental material|supplemental information|supporting materials)[^\S\n]*[.:]?[^\S\n]*$') THEN 'supplement' ELSE 'main' END AS kind,
        rtrim(regexp_extract(body, '(?i)10\.\d{4,9}/[-._;()/:A-Z0-9]+'), '.,;:') AS found,
        upper(regexp_extract(body, '(?i)\bPMC\d{5,10}\b')) AS pmc, regexp_extract(body, '(?i)\bPMID\s*[:#]?\s*(\d{5,10})\b', 1) AS pm,
        trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')) AS nt
      FROM f),
    w AS (
      SELECT *, lower(left(found, length(found) - least(greatest(length(replace(found, '(', '')) - length(replace(found, ')', '')), 0), length(regexp_extract(found, '\)+$'))))) AS di FROM x),
    u AS (
      SELECT *, CASE WHEN di <> '' THEN 'doi' WHEN pmc <> '' THEN 'pmcid' WHEN pm <> '' THEN 'pmid' WHEN y IS NOT NULL AND length(nt) >= 35 AND len(string_split(nt, ' ')) >= 5 THEN 'title_year' ELSE 'sha256' END AS typ
      FROM w),
    v AS (
      SELECT *, CASE typ WHEN 'doi' THEN di WHEN 'pmcid' THEN pmc WHEN 'pmid' THEN pm WHEN 'title_year' THEN title || ' (' || y || ')' ELSE file_hash END AS value
      FROM u)
    SELECT doc_id, filename, file_hash,
      CASE WHEN typ = 'title_year' THEN 'titleyear:' || y || ':' || left(sha256(nt), 24) ELSE typ || ':' || value END
        || CASE WHEN kind <> 'main' AND typ <> 'sha256' THEN ':' || kind ELSE '' END AS canonical_key,
      typ AS identity_type, value AS identity_value,
      CASE WHEN typ IN ('doi', 'pmcid', 'pmid') THEN 'high' WHEN typ = 'title_year' THEN 'medium' ELSE 'exact_file_only' END AS confidence,
      kind AS document_kind, CASE WHEN typ = 'doi' THEN value ELSE '' END AS doi, CASE WHEN typ = 'pmcid' THEN value ELSE '' END AS pmcid,
      CASE WHEN typ = 'pmid' THEN value ELSE '' END AS pmid, title, nt AS normalized_title, y AS publication_year
    FROM v
    """
)
def resolve_identity(spark, folder):
    doc, kind = F.col("doc_id"), F.col("doc_id") % 6
    tail = (
        F.when(kind == 0, F.concat(F.lit("see doi:10.1234/"), F.upper("source"), F.lit("("), doc, F.lit(")).\n S2. Supporting Information:  \nTable")))
        .when(kind == 1, F.concat(F.lit("as pmc"), doc + 1_000_000, F.lit(" and PMID: "), doc + 2_000_000))
        .when(kind == 2, F.concat(F.lit("with PMID# "), doc + 2_000_000, F.lit(", Supporting Information, 2031 and 1998")))
        .when(kind == 3, F.lit("published 2150, 2019"))
        .when(kind == 4, F.lit("see Supplementary Information for details"))
        .otherwise(F.concat(F.lit("doi 10.99999/x."), doc, F.lit(". The Supplementary material 2026")))
    )
    files = table(spark, folder, "documents").select(
        "doc_id",
        F.sha2("text", 256).alias("file_hash"),
        F.concat("source", F.lit("_"), doc, F.lit(".pdf")).alias("filename"),
        F.concat(F.lit("A Study of "), "source", F.lit(" with Many More Words in "), "lang", F.lit(" Corpora")).alias("title"),
        F.concat("text", F.lit("\n"), tail).alias("text"),
    )
    return identity.resolve_identity(files, AS_OF_YEAR)


@query(
    """
    SELECT o_orderkey, CAST(CASE o_orderkey % 3 WHEN 0 THEN year(o_orderdate) WHEN 1 THEN 2001 END AS INT) AS publication_year
    FROM orders
    """
)
def extract_year(spark, folder):
    """Years that lie in the future, or are part of a longer number, are passed over."""
    kind = F.col("o_orderkey") % 3
    text = F.when(kind < 2, F.concat(F.lit("by 2099; no. 19991, "), "o_orderpriority")).otherwise(F.lit("12020 1850 2077"))
    title = F.when(kind == 0, F.concat(F.lit("On "), F.year("o_orderdate"), F.lit(" sales"))).otherwise(F.lit("Sales"))
    filename = F.when(kind == 1, F.lit("s-2001.pdf")).otherwise(F.lit("s.pdf"))
    year = identity.publication_year(text, title, filename, AS_OF_YEAR)
    return table(spark, folder, "orders").select("o_orderkey", year.alias("publication_year"))


@query(
    """
    SELECT sha256(text) AS canonical_key, arg_max(lang, doc_id) AS lang, arg_max(source, doc_id) AS source, min(doc_id) AS first_seen_at,
      max(doc_id) AS last_seen_at, count(*) AS n_files, min(lang) <> max(lang) AS has_conflict
    FROM documents GROUP BY 1
    """
)
def entity_rollup(spark, folder):
    files = table(spark, folder, "documents").select(F.sha2("text", 256).alias("canonical_key"), "doc_id", "lang", "source")
    return identity.entity_rollup(files, "canonical_key", "doc_id", ["lang", "source"], "doc_id")


@query("SELECT count(*) AS n_rows FROM documents")
def row_count(spark, folder):
    return keyed.row_count(table(spark, folder, "documents"))


@query("SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey = 77")
def key_lookup(spark, folder):
    return keyed.point_read(table(spark, folder, "customer"), "c_custkey", 77, ["c_custkey", "c_name", "c_acctbal"])


_UPSERT_SQL = """
    WITH last AS (SELECT o_custkey AS k, arg_max(o_totalprice, {'a': o_orderdate, 'b': o_orderkey}) AS bal FROM orders GROUP BY 1),
    u AS (SELECT k, bal, NULL AS name FROM last UNION ALL SELECT s_suppkey + 10000000, s_acctbal, s_name FROM supplier)
    SELECT coalesce(c_custkey, k) AS c_custkey, coalesce(c_name, 'new') AS c_name, coalesce(c_nationkey, -1) AS c_nationkey,
      CASE WHEN k IS NOT NULL THEN bal ELSE c_acctbal END AS c_acctbal, CASE WHEN k IS NOT NULL THEN 'TOUCHED' ELSE c_mktsegment END AS c_mktsegment
    FROM customer FULL OUTER JOIN u ON c_custkey = k
"""


def _latest_balances(spark, folder):
    orders = table(spark, folder, "orders").select(
        F.col("o_custkey").alias("c_custkey"), F.col("o_totalprice").alias("c_acctbal"), "o_orderdate", "o_orderkey"
    )
    return keyed.dedupe_last(orders, ["c_custkey"], ["o_orderdate", "o_orderkey"]).select("c_custkey", "c_acctbal")


def _supplied(spark, folder):
    return table(spark, folder, "supplier").select((F.col("s_suppkey") + 10_000_000).alias("c_custkey"), F.col("s_acctbal").alias("c_acctbal"))


def _set():
    """Defaults of new rows and what every written row gets."""
    return {"c_name": F.lit("new"), "c_nationkey": F.lit(-1)}, {"c_mktsegment": F.lit("TOUCHED")}


@query(_UPSERT_SQL)
def upsert_customers(spark, folder):
    updates = _latest_balances(spark, folder).unionByName(_supplied(spark, folder))
    return keyed.upsert(table(spark, folder, "customer"), updates, ["c_custkey"], *_set())


@query(_UPSERT_SQL)
def upsert_buckets(spark, folder):
    """The same upsert in three commits of a table that is stored in buckets of its key; each commit rewrites only the buckets it touches."""
    customers = table(spark, folder, "customer")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in customers.schema)
    stored = BucketedTable(spark, shared_folder(spark, "customers"), schema, ["c_custkey"])
    stored.create(customers)
    balances = _latest_balances(spark, folder)
    rich = F.col("c_acctbal") > 100_000
    for version, updates in enumerate((_supplied(spark, folder), balances.where(rich), balances.where(~rich)), 1):
        stored.upsert(updates, version, version - 1, *_set())
    return stored.read()


@query(
    """
    WITH c AS (SELECT s_suppkey * 50 AS p_partkey, 'supplied' AS p_name, s_name AS p_brand, 'NEW' AS p_type, 0 AS p_size, s_acctbal AS p_retailprice, s_suppkey AS pos FROM supplier
      UNION ALL SELECT s_suppkey * 50, 'second', s_name, 'NEW', 1, s_acctbal, s_suppkey + 1000000 FROM supplier),
    f AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY pos) = 1)
    SELECT * FROM part UNION ALL SELECT * EXCLUDE (pos) FROM f WHERE p_partkey NOT IN (SELECT p_partkey FROM part)
    """
)
def insert_if_absent(spark, folder):
    suppliers = table(spark, folder, "supplier")

    def offered(name, size, shift):
        return suppliers.select(
            (F.col("s_suppkey") * 50).alias("p_partkey"), F.lit(name).alias("p_name"), F.col("s_name").alias("p_brand"),
            F.lit("NEW").alias("p_type"), F.lit(size).alias("p_size"), F.col("s_acctbal").alias("p_retailprice"),
            (F.col("s_suppkey") + shift).alias("pos"),
        )

    candidates = offered("supplied", 0, 0).unionByName(offered("second", 1, 1_000_000))
    return keyed.insert_if_absent(table(spark, folder, "part"), candidates, ["p_partkey"], ["pos"])


@query(
    """
    WITH r AS (SELECT o_orderkey, n AS l_linenumber, CASE WHEN o_orderstatus = 'F' THEN 'A' ELSE 'R' END AS l_returnflag, 'F' AS l_linestatus
      FROM orders, (VALUES (1), (2), (3)) t(n))
    SELECT r.o_orderkey AS l_orderkey, r.l_linenumber, r.l_returnflag, r.l_linestatus, l_partkey, l_quantity
    FROM r JOIN lineitem l ON l.l_orderkey = r.o_orderkey AND l.l_linenumber = r.l_linenumber AND l.l_returnflag = r.l_returnflag AND l.l_linestatus = r.l_linestatus
    """
)
def stage_lookup(spark, folder):
    keys = ["l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus"]
    requests = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("l_orderkey"),
        F.explode(F.array(*[F.lit(n) for n in (1, 2, 3)])).alias("l_linenumber"),
        F.when(F.col("o_orderstatus") == "F", "A").otherwise("R").alias("l_returnflag"),
        F.lit("F").alias("l_linestatus"),
    )
    cache = table(spark, folder, "lineitem").select(*keys, "l_partkey", "l_quantity")
    return keyed.stage_lookup(requests, cache, keys)


@query(
    """
    SELECT c_custkey, stage FROM customer, (VALUES ('1-URGENT'), ('2-HIGH'), ('3-MEDIUM'), ('4-NOT SPECIFIED'), ('5-LOW')) s(stage)
    WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = stage AND o_orderstatus = 'F')
    """
)
def plan_missing(spark, folder):
    stages = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
    cache = table(spark, folder, "orders").select(
        F.col("o_custkey").alias("c_custkey"), F.col("o_orderpriority").alias("stage"), F.col("o_orderstatus").alias("analysis_version")
    )
    return keyed.plan_missing(table(spark, folder, "customer"), "c_custkey", stages, cache, version="F")


@query(
    """
    WITH a AS (SELECT sha256(text) AS file_hash, min(source) AS canonical_key FROM documents GROUP BY 1),
    e AS (SELECT source AS canonical_key, count(*) AS n_docs, max(n_chars) AS longest FROM documents GROUP BY 1)
    SELECT l.doc_id, l.quality, a.file_hash, a.canonical_key, n_docs, longest
    FROM labels l JOIN documents d USING (doc_id) JOIN a ON a.file_hash = sha256(d.text) JOIN e USING (canonical_key)
    """
)
def file_to_entity(spark, folder):
    hashed = table(spark, folder, "documents").select("doc_id", "source", F.sha2("text", 256).alias("file_hash"))
    aliases = hashed.groupBy("file_hash").agg(F.min("source").alias("canonical_key"))
    entities = table(spark, folder, "documents").groupBy(F.col("source").alias("canonical_key")).agg(
        F.count("*").alias("n_docs"), F.max("n_chars").alias("longest")
    )
    requests = table(spark, folder, "labels").select("doc_id", "quality").join(hashed.select("doc_id", "file_hash"), "doc_id")
    return keyed.file_to_entity(requests, aliases, entities)


def _promotion(folder_table, keep):
    legacy = folder_table("orders").select(
        F.concat(F.lit("h"), F.col("o_orderkey")).alias("file_hash"),
        F.col("o_orderpriority").alias("depth"),
        F.col("o_orderstatus").alias("stage"),
        F.lit("v1").alias("analysis_version"),
        F.concat(F.lit("m"), F.col("o_orderkey")).alias("model"),
        F.when(F.col("o_orderkey") % 2 == 0, F.lit(3)).cast("bigint").alias("hit_count"),
        F.col("o_orderdate").alias("updated_at"),
    )
    aliases = folder_table("orders").select(
        F.concat(F.lit("h"), F.col("o_orderkey")).alias("file_hash"), F.col("o_custkey").alias("canonical_key")
    )
    current = folder_table("customer").select(
        F.col("c_custkey").alias("canonical_key"),
        F.lit("1-URGENT").alias("depth"),
        F.lit("F").alias("stage"),
        F.lit("v1").alias("analysis_version"),
        F.lit("stored").alias("model"),
        F.lit(5).cast("bigint").alias("hit_count"),
        F.lit("1997-06-01").cast("timestamp_ntz").alias("updated_at"),
    )
    state = keyed.promote_legacy(legacy, aliases, current, {"hit_count": F.lit(0).cast("bigint")}, keep)
    return state.withColumn("updated_at", F.col("updated_at").cast("date").cast("string"))


_PROMOTION_SQL = """
    WITH m AS (
      SELECT o_custkey AS canonical_key, o_orderpriority AS depth, o_orderstatus AS stage, 'v1' AS analysis_version, 'm' || o_orderkey AS model,
        CASE WHEN o_orderkey % 2 = 0 THEN 3 ELSE 0 END AS hit_count, o_orderdate AS updated_at
      FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderpriority, o_orderstatus ORDER BY o_orderdate DESC, 'm' || o_orderkey DESC) = 1),
    c AS (SELECT c_custkey AS canonical_key, '1-URGENT' AS depth, 'F' AS stage, 'v1' AS analysis_version, 'stored' AS model, 5 AS hit_count,
            TIMESTAMP '1997-06-01' AS updated_at FROM customer),
    j AS (SELECT coalesce(m.canonical_key, c.canonical_key) AS canonical_key, coalesce(m.depth, c.depth) AS depth, coalesce(m.stage, c.stage) AS stage,
            'v1' AS analysis_version, m.model IS NOT NULL AND ({take}) AS use_m, m.model AS mm, m.hit_count AS mh, m.updated_at AS mu, c.model AS cm, c.hit_count AS ch, c.updated_at AS cu
          FROM m FULL OUTER JOIN c ON m.canonical_key = c.canonical_key AND m.depth = c.depth AND m.stage = c.stage)
    SELECT canonical_key, depth, stage, analysis_version, CASE WHEN use_m THEN mm ELSE cm END AS model, CAST(CASE WHEN use_m THEN mh ELSE ch END AS BIGINT) AS hit_count,
      strftime(CASE WHEN use_m THEN mu ELSE cu END, '%Y-%m-%d') AS updated_at
    FROM j
    """


@query(_PROMOTION_SQL.replace("{take}", "c.model IS NULL OR m.updated_at > c.updated_at"))
def promote_legacy(spark, folder):
    return _promotion(lambda name: table(spark, folder, name), "newest")


@query(_PROMOTION_SQL.replace("{take}", "TRUE"))
def promote_legacy_overwrite(spark, folder):
    """The replacing variant: a promoted row wins over a stored one, hit count included."""
    return _promotion(lambda name: table(spark, folder, name), "legacy")


@query(
    """
    WITH h AS (SELECT user_id, count(*) AS n FROM events GROUP BY 1),
    d AS (SELECT user_id, count(*) AS n_days FROM (SELECT DISTINCT user_id, CAST(ts AS DATE) FROM events) GROUP BY 1)
    SELECT c_custkey, c_nationkey + coalesce(n, 0) AS hits, CAST(coalesce(n_days, 0) AS BIGINT) AS request_hits
    FROM customer LEFT JOIN h ON h.user_id = c_custkey LEFT JOIN d ON d.user_id = c_custkey
    """
)
def hit_counts(spark, folder):
    """Every hit counts in one counter; in the other an item counts once per request (here: day)."""
    events = table(spark, folder, "events").select(F.col("user_id").alias("c_custkey"), F.to_date("ts").alias("request"))
    customers = table(spark, folder, "customer").select(
        "c_custkey", F.col("c_nationkey").cast("bigint").alias("hits"), F.lit(0).cast("bigint").alias("request_hits")
    )
    counted = keyed.add_hits(customers, keyed.count_hits(events, "c_custkey"), "c_custkey", "hits")
    return keyed.add_hits(counted, keyed.count_hits(events, "c_custkey", "request"), "c_custkey", "request_hits")


@query(
    """
    SELECT sha256(text) AS text_hash, min(doc_id) AS doc_id, arg_min(source, doc_id) AS source FROM documents GROUP BY 1
    """
)
def dedupe_first(spark, folder):
    docs = table(spark, folder, "documents").select(F.sha2("text", 256).alias("text_hash"), "doc_id", "source")
    return keyed.dedupe_first(docs, ["text_hash"], ["doc_id"])


# --- concept archive -----------------------------------------------------------------------------------------------


def _requests(spark, folder):
    raw = F.concat(
        F.lit(" "), "p_name", F.lit(", "), "p_brand", F.lit(";"), F.upper("p_name"), F.lit(".\n,"), "p_type", F.lit("; ("), "p_type", F.lit(")")
    )
    return archive.parse_terms(table(spark, folder, "part").withColumn("raw", raw), "raw", "p_partkey")


_TERMS_SQL = """
    WITH t AS (
      SELECT p_partkey, 0 AS pos, p_name AS term, lower(p_name) AS normalized FROM part
      UNION ALL SELECT p_partkey, 1, p_brand, lower(p_brand) FROM part
      UNION ALL SELECT p_partkey, 2, p_type, lower(p_type) FROM part)
"""


@query(_TERMS_SQL + "SELECT p_partkey, pos, term, normalized FROM t")
def parse_terms(spark, folder):
    return _requests(spark, folder)


def _archive(spark, folder):
    parts = table(spark, folder, "part")
    concepts = parts.groupBy(F.lower("p_name").alias("normalized_name")).agg(F.min("p_partkey").alias("id"))
    aliases = parts.groupBy(F.lower("p_brand").alias("alias_normalized")).agg(F.min("p_name").alias("n"))
    aliases = aliases.join(concepts, F.col("n") == F.col("normalized_name")).select(
        "alias_normalized", F.col("id").alias("concept_id")
    )
    # a name that is an alias of another concept too: the direct match must win
    clash = concepts.select(F.col("normalized_name").alias("alias_normalized"), F.lit(-1).cast("bigint").alias("concept_id"))
    return concepts, aliases.unionByName(clash)


def _resolved(spark, folder):
    concepts, aliases = _archive(spark, folder)
    wanted = archive.wanted_terms(_requests(spark, folder), "normalized", "term", ["p_partkey", "pos"])
    return archive.resolve_terms(wanted, concepts, aliases)


_RESOLVED_SQL = _TERMS_SQL + """
    , w AS (SELECT normalized, arg_max(term, {'a': p_partkey, 'b': pos}) AS term, count(*) AS n_requests FROM t GROUP BY 1),
    c AS (SELECT lower(p_name) AS name, min(p_partkey) AS id FROM part GROUP BY 1),
    al AS (SELECT lower(p_brand) AS alias, min(p_name) AS name FROM part GROUP BY 1),
    r AS (SELECT w.*, coalesce(c.id, c2.id) AS concept_id, CASE WHEN c.id IS NOT NULL THEN 'name' WHEN c2.id IS NOT NULL THEN 'alias' END AS matched_by
          FROM w LEFT JOIN c ON c.name = normalized LEFT JOIN al ON al.alias = normalized LEFT JOIN c c2 ON c2.name = al.name)
"""


@query(_RESOLVED_SQL + "SELECT normalized, term, n_requests, concept_id, matched_by FROM r WHERE concept_id IS NOT NULL")
def alias_lookup(spark, folder):
    return archive.term_hits(_resolved(spark, folder))


@query(_RESOLVED_SQL + "SELECT normalized, term, n_requests FROM r WHERE concept_id IS NULL")
def alias_misses(spark, folder):
    return archive.term_misses(_resolved(spark, folder))


@query(
    _RESOLVED_SQL
    + """
    SELECT CASE WHEN concept_id IS NULL THEN 'miss' ELSE 'hit' END AS side, count(*) AS n_terms,
      CAST(0 AS BIGINT) AS n_in_both, CAST(0 AS BIGINT) AS n_lost FROM r GROUP BY 1
    """
)
def hit_miss_partition(spark, folder):
    """Every normal form is on exactly one side."""
    resolved = _resolved(spark, folder)
    hits = archive.term_hits(resolved).select("normalized", F.lit("hit").alias("side"))
    misses = archive.term_misses(resolved).select("normalized", F.lit("miss").alias("side"))
    wanted = _requests(spark, folder).select("normalized").distinct().withColumn("__wanted", F.lit(True))
    sides = wanted.join(hits.unionByName(misses), "normalized", "full_outer")
    per_term = sides.groupBy("normalized").agg(F.count("side").alias("n"), F.max("side").alias("side"))
    return per_term.groupBy(F.coalesce("side", F.lit("none")).alias("side")).agg(
        F.count("*").alias("n_terms"),
        F.count(F.when(F.col("n") > 1, 1)).alias("n_in_both"),
        F.count(F.when(F.col("n") == 0, 1)).alias("n_lost"),
    )


@query(
    """
    SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN lower(p_brand) || '|' ELSE '' END || lower(p_type) AS aliases FROM part
    """
)
def alias_union(spark, folder):
    requested = F.when(F.col("p_size") % 2 == 0, F.concat(F.col("p_brand"), F.lit("."))).otherwise(F.upper("p_name"))
    offered = F.array(F.col("p_type"), F.concat(F.lit(" "), F.col("p_name")), F.concat(F.lit("("), F.col("p_type"), F.lit(")")), F.lit(" "))
    merged = archive.alias_union(requested, F.col("p_name"), offered)
    return table(spark, folder, "part").select("p_partkey", F.array_join(merged, "|").alias("aliases"))


@query(
    """
    WITH u AS (
      SELECT upper(p_name) AS english, p_partkey AS pos, 0 AS source_rank FROM part
      UNION ALL SELECT p_name, p_partkey, 1 FROM part UNION ALL SELECT p_type, p_partkey, 1 FROM part)
    SELECT english, pos, source_rank FROM u QUALIFY row_number() OVER (PARTITION BY lower(english) ORDER BY source_rank, pos) = 1
    """
)
def priority_union(spark, folder):
    parts = table(spark, folder, "part")
    smart = parts.select(F.upper("p_name").alias("english"), F.col("p_partkey").alias("pos"))
    seed = parts.select(F.explode(F.array("p_name", "p_type")).alias("english"), F.col("p_partkey").alias("pos"))
    return archive.priority_union(smart, seed, "english")


@query(
    """
    WITH n AS (SELECT lower(p_name) AS normalized_name, arg_min(p_name, p_partkey) AS canonical_name, arg_min(p_type, p_partkey) AS definition_en FROM part GROUP BY 1),
    old AS (SELECT 'old-' || min(p_partkey) AS id, lower(p_name) AS normalized_name, 'kept' AS definition_en FROM part WHERE starts_with(p_name, 'red') GROUP BY lower(p_name))
    SELECT coalesce(old.id, sha256(n.normalized_name)) AS id, n.normalized_name, coalesce(old.definition_en, n.definition_en) AS definition_en,
      CASE WHEN old.id IS NULL THEN 'AI_GENERATED' ELSE 'CURATED' END AS quality_status
    FROM n LEFT JOIN old USING (normalized_name)
    """
)
def ingest_concepts(spark, folder):
    return _ingested(spark, folder)[0]


@query(
    """
    WITH o AS (SELECT lower(p_name) AS n, 'old-' || min(p_partkey) AS id FROM part WHERE starts_with(p_name, 'red') GROUP BY 1),
    a AS (SELECT lower(p_brand) AS alias_normalized, p_partkey, lower(p_name) AS n FROM part UNION ALL SELECT lower(p_type), p_partkey, lower(p_name) FROM part),
    f AS (SELECT alias_normalized, arg_min(n, p_partkey) AS n FROM a GROUP BY 1)
    SELECT alias_normalized, coalesce(o.id, sha256(f.n)) AS concept_id FROM f LEFT JOIN o USING (n) UNION ALL SELECT 'reserved', 'x'
    """
)
def ingest_aliases(spark, folder):
    return _ingested(spark, folder)[1].select("alias_normalized", "concept_id")


def _ingested(spark, folder):
    parts = table(spark, folder, "part")
    stored = parts.where(F.col("p_name").startswith("red")).groupBy(F.lower("p_name").alias("normalized_name")).agg(
        F.concat(F.lit("old-"), F.min("p_partkey")).alias("id"), F.lit("kept").alias("definition_en"), F.lit("CURATED").alias("quality_status")
    )
    concepts = stored.select("id", "normalized_name", "definition_en", "quality_status")
    aliases = parts.agg(*[F.max(F.lit(v)).alias(c) for c, v in zip(("concept_id", "alias_display", "alias_normalized"), ("x", "Reserved", "reserved"))])
    explanations = parts.select(
        F.col("p_brand").alias("requested_term"), F.col("p_name").alias("canonical_name"), F.array("p_type", "p_name").alias("aliases"),
        F.col("p_type").alias("definition_en"), F.lit(None).cast("string").alias("difficulty"), "p_partkey",
    )
    return archive.ingest_explanations(concepts, aliases, explanations, ["p_partkey"])


# --- linking -------------------------------------------------------------------------------------------------------


def _dictionary(spark, folder):
    parts = table(spark, folder, "part")
    words = parts.groupBy(F.col("p_name").alias("alias")).agg(F.min("p_partkey").alias("pos"))
    return words.select("alias", F.concat(F.lit("M:"), F.col("alias")).alias("canonical"), "pos")


def _noisy_names(spark, folder):
    size = F.col("p_size") % 5
    noisy = (
        F.when(size == 0, F.col("p_name"))
        .when(size == 1, F.concat(F.lit("the "), "p_name", F.lit(" method")))
        .when(size == 2, F.element_at(F.split("p_name", " "), 2))
        .when(size == 3, F.regexp_replace("p_name", "([a-z]) ([a-z])", "$1$2"))
        .otherwise(F.lower("p_type"))
    )
    return table(spark, folder, "part").select(noisy.alias("name"))


_NAMES_SQL = """
    WITH n AS (SELECT DISTINCT CASE p_size % 5 WHEN 0 THEN p_name WHEN 1 THEN 'the ' || p_name || ' method' WHEN 2 THEN split_part(p_name, ' ', 2)
        WHEN 3 THEN replace(p_name, ' ', '') ELSE lower(p_type) END AS name FROM part),
    d AS (SELECT p_name AS alias, 'M:' || p_name AS canonical FROM part GROUP BY 1),
    e AS (SELECT name, canonical, 'exact' AS tier FROM n JOIN d ON name = alias),
    c AS (SELECT name, arg_max(canonical, {'a': length(alias), 'b': canonical}) AS canonical, 'contains' AS tier
          FROM n JOIN d ON contains(name, alias) OR contains(alias, name) WHERE name NOT IN (SELECT name FROM e) GROUP BY name)
"""


@query(_NAMES_SQL + "SELECT * FROM e UNION ALL SELECT * FROM c")
def entity_link_exact_contains(spark, folder):
    links = linking.entity_links(_noisy_names(spark, folder), _dictionary(spark, folder))
    return links.where(F.col("tier") != "fuzzy")


@query(
    _NAMES_SQL
    + """, f AS (
      SELECT DISTINCT replace(p_name, ' ', '') AS name, 'M:' || p_name AS canonical, 'fuzzy' AS tier FROM part
      WHERE p_size % 5 = 3 AND 2.0 * (length(p_name) - 1) / (2 * length(p_name) - 1) >= 0.82 AND length(p_name) - length(replace(p_name, ' ', '')) = 1)
    SELECT * FROM e UNION ALL SELECT * FROM c UNION ALL SELECT * FROM f WHERE name NOT IN (SELECT name FROM e) AND name NOT IN (SELECT name FROM c)"""
)
def entity_link(spark, folder):
    """All three tiers.  Names for the fuzzy one lack the blank of their alias, so their similarity is 2(n - 1) / (2n - 1)."""
    return linking.entity_links(_noisy_names(spark, folder), _dictionary(spark, folder))


@query(
    """
    WITH l AS (SELECT DISTINCT p_brand, p_size, CASE WHEN p_partkey % 3 = 2 THEN '' ELSE chr(CAST(97 + p_partkey % 3 AS INT)) END AS s FROM part),
    f AS (SELECT DISTINCT p_brand, 'fig' || p_size || CASE s WHEN 'a' THEN 'a' ELSE '' END AS figure_key FROM l WHERE s <> '')
    SELECT l.p_brand, 'fig' || p_size || s AS label_key, coalesce(f1.figure_key, f2.figure_key) AS figure_key
    FROM l LEFT JOIN f f1 ON f1.p_brand = l.p_brand AND f1.figure_key = 'fig' || p_size || s LEFT JOIN f f2 ON f2.p_brand = l.p_brand AND f2.figure_key = 'fig' || p_size
    """
)
def label_link(spark, folder):
    parts = table(spark, folder, "part")
    suffix = F.when(F.col("p_partkey") % 3 == 2, "").otherwise(F.char(F.lit(97) + F.col("p_partkey") % 3))
    rows = parts.select("p_brand", "p_size", suffix.alias("s")).distinct()
    labels = rows.select("p_brand", F.concat(F.lit("fig"), F.col("p_size"), F.col("s")).alias("label_key"))
    # parts of the first kind have a figure of their own letter, those of the second kind the base figure
    key = F.when(F.col("s") == "a", F.concat(F.lit("fig"), "p_size", F.lit("a"))).when(F.col("s") == "b", F.concat(F.lit("fig"), "p_size"))
    figures = rows.select("p_brand", key.alias("figure_key")).where("figure_key IS NOT NULL").distinct()
    return linking.label_links(labels, figures, ["p_brand"])


@query(
    """
    SELECT page_id, 'img/Fig' || page_id || '.JPG' AS href,
      CASE CAST(page_id % 4 AS INT) WHEN 0 THEN 'cache/fig' || page_id || '.jpg' WHEN 1 THEN 'cache/fig' || page_id || '.png' WHEN 2 THEN 'cache/xfig' || page_id || '-large.tiff' END AS path,
      CAST(page_id % 4 + 1 AS INT) AS tier
    FROM pages WHERE page_id % 4 < 3
    """
)
def match_assets(spark, folder):
    page = F.col("page_id").cast("string")
    kind = F.col("page_id") % 4
    pages = table(spark, folder, "pages")
    refs = pages.select("page_id", F.concat(F.lit("img/Fig"), page, F.lit(".JPG")).alias("href"))
    large = F.concat(F.lit("cache/xfig"), page, F.lit("-large.tiff"))
    files = F.array_compact(
        F.array(
            F.when(kind == 0, F.concat(F.lit("cache/fig"), page, F.lit(".jpg"))),
            F.when(kind < 2, F.concat(F.lit("cache/fig"), page, F.lit(".png"))),
            F.when(kind < 3, large),
            F.concat(F.lit("cache/_fig"), page, F.lit(".jpg")),
            F.concat(F.lit("cache/fig"), page, F.lit(".txt")),
            F.lit("cache/other.gif"),
        )
    )
    return linking.match_assets(refs, pages.select("page_id", F.explode(files).alias("path")), ["page_id"])


@query(
    """
    WITH f AS (SELECT p_brand, p_size AS size, 'out/' || p_brand || '/' || CASE CAST(p_partkey % 6 AS INT) WHEN 0 THEN 'x_middle.json' WHEN 1 THEN 'middle.json'
        WHEN 2 THEN 'layout.json' WHEN 3 THEN 'a-layout.json' WHEN 4 THEN 'other.json' ELSE 'Y_MIDDLE.JSON' END AS path FROM part),
    r AS (SELECT *, CASE WHEN ends_with(lower(path), '_middle.json') THEN 4 WHEN ends_with(path, '/middle.json') THEN 3 WHEN ends_with(path, '/layout.json') THEN 2
        WHEN ends_with(path, 'layout.json') THEN 1 END AS rank FROM f)
    SELECT p_brand, path AS picked_path, rank AS name_rank FROM r WHERE rank IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY rank DESC, size DESC, path DESC) = 1
    """
)
def pick_artifact(spark, folder):
    names = ["x_middle.json", "middle.json", "layout.json", "a-layout.json", "other.json", "Y_MIDDLE.JSON"]
    kind = (F.col("p_partkey") % 6).cast("int")
    name = F.element_at(F.array(*[F.lit(n) for n in names]), kind + 1)
    files = table(spark, folder, "part").select(
        "p_brand", F.concat(F.lit("out/"), "p_brand", F.lit("/"), name).alias("path"), F.col("p_size").alias("size")
    )
    return linking.pick_artifact(files, ["p_brand"])


@query(
    """
    WITH a AS (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_returnflag = 'A'),
    p AS (SELECT l_orderkey, l_partkey, 'primary' AS engine FROM lineitem WHERE l_returnflag = 'A'),
    f AS (SELECT l_orderkey, l_partkey, 'fallback' AS engine FROM lineitem WHERE l_returnflag = 'R' AND l_orderkey NOT IN (SELECT l_orderkey FROM a))
    SELECT * FROM p UNION ALL SELECT * FROM f
    """
)
def prefer_source(spark, folder):
    lines = table(spark, folder, "lineitem")

    def engine(flag):
        return lines.where(F.col("l_returnflag") == flag).select("l_orderkey", "l_partkey")

    return linking.prefer_source(engine("A"), engine("R"), "l_orderkey")
