"""Catalogue: dictionary terms in full text, taxonomy, search, captions and panels."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuskit.functions.labels import figure_number
from corpuskit.functions.text import normalize_match_text
from corpuskit.operators import dictionary, panels, search, taxonomy
from corpuskit.operators.ordered import best_per_key as best_rows
from corpuskit.operators.ordered import top_k
from corpuskit.plans.registry import query
from corpuskit.sources import profiles
from corpuskit.sources.tables import spread, table

# (alias, canonical): words and lines that occur in the documents; one alias is listed twice, some overlap
TERMS = [
    ("the", "THE"),
    ("The", "THE"),
    ("of", "OF"),
    ("of the", "OF"),
    ("MIT License", "LICENSE"),
    ("License", "LICENSE"),
    ("de", "DE"),
    ("de la", "DE"),
    ("la", "DE"),
    ("der", "DER"),
    ("für", "DER"),
    ("que", "QUE"),
    ("and the", "AND"),
    ("no such term", "NONE"),
]


def _terms(spark):
    return spark.createDataFrame(TERMS, "alias string, canonical string")


def _doubled(term: str) -> str:
    """Search pattern for a text in which every character but ASCII letters and digits stands twice."""
    out = ""
    for ch in term:
        plain = ch.isascii() and ch.isalnum()
        quoted = ch if ch.isalnum() or ch == " " else "\\" + ch
        out += quoted if plain else quoted * 2
    return f"(?i)(^|[^A-Za-z0-9]){out}([^A-Za-z0-9]|$)"


_TERM_VALUES = ", ".join(f"('{a}', '{c}', '{_doubled(a)}')" for a, c in TERMS)
_COUNTS_SQL = rf"""
    WITH terms(alias, canonical, pattern) AS (VALUES {_TERM_VALUES}),
    d AS (SELECT doc_id, regexp_replace(text, '([^A-Za-z0-9])', '\1\1', 'g') AS t FROM documents),
    h AS (SELECT doc_id, canonical, CAST(sum(len(regexp_extract_all(t, pattern))) AS BIGINT) AS hits FROM d, terms GROUP BY ALL),
    c AS (SELECT * FROM h WHERE hits > 0)
"""


@query(_COUNTS_SQL + "SELECT doc_id, canonical, hits FROM c")
def term_counts(spark, folder):
    return dictionary.term_counts(table(spark, folder, "documents"), _terms(spark))


@query(_COUNTS_SQL + "SELECT canonical, CAST(sum(hits) AS BIGINT) AS total_hits, count(*) AS n_docs, max(hits) AS max_hits FROM c GROUP BY 1")
def method_totals(spark, folder):
    return dictionary.term_totals(term_counts(spark, folder))


@query(_COUNTS_SQL + "SELECT doc_id, count(*) AS n_terms, CAST(sum(hits) AS BIGINT) AS total_hits FROM c GROUP BY 1")
def terms_per_document(spark, folder):
    return dictionary.terms_per_document(term_counts(spark, folder))


@query(
    _COUNTS_SQL
    + """SELECT doc_id, canonical, hits, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY hits DESC, canonical) AS INT) AS rank FROM c
         QUALIFY rank <= 3"""
)
def top_terms(spark, folder):
    return dictionary.top_terms(term_counts(spark, folder), 3)


def _word_terms(docs):
    """Terms from the data: every word of eight letters or more."""
    words = F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{8,}"), F.lit(0))
    return docs.select(F.explode(words).alias("alias")).distinct().withColumn("canonical", F.left("alias", F.lit(9)))


_LARGE_SQL = r"""
    WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]{8,}')) AS alias FROM documents),
    tok AS (SELECT doc_id, unnest(string_split_regex(lower(text), '[^a-z0-9]+')) AS alias FROM documents)
"""


@query(_LARGE_SQL + "SELECT doc_id, left(alias, 9) AS canonical, count(*) AS hits FROM tok JOIN w USING (alias) GROUP BY 1, 2")
def term_counts_large(spark, folder):
    """Counts against thousands of terms that come from the documents themselves."""
    docs = table(spark, folder, "documents")
    return dictionary.term_counts(docs, _word_terms(docs))


@query(
    r"""
    WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]{12,}')) AS term FROM documents),
    d AS (SELECT doc_id, trim(regexp_replace(replace(lower(text), 'ß', 'ss'), '[^a-z0-9가-힣]+', ' ', 'g')) AS norm FROM documents),
    tok AS (SELECT DISTINCT doc_id, unnest(string_split(norm, ' ')) AS t FROM d),
    u AS (SELECT t, term FROM (SELECT DISTINCT t FROM tok WHERE length(t) >= 12) JOIN w ON contains(t, term))
    SELECT DISTINCT doc_id, term FROM tok JOIN u USING (t)
    """
)
def mention_join_large(spark, folder):
    """Substring mentions of thousands of terms that come from the documents themselves."""
    docs = table(spark, folder, "documents")
    words = F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{12,}"), F.lit(0))
    terms = docs.select(F.explode(words).alias("term")).distinct()
    return dictionary.mention_pairs(docs.select("doc_id", normalize_match_text("text").alias("norm")), terms, "doc_id", "norm", "term")


_GLOSSARY = [("der Die", "가"), ("MIT License", "나"), ("the", "다"), ("tion", "라"), ("License", "마"), ("onenerth edonre", "바")]


@query(
    """
    WITH g(surface, n) AS (VALUES ('onenerth edonre', 1), ('MIT License', 2), ('der Die', 3), ('License', 4), ('tion', 5), ('the', 6))
    SELECT doc_id, coalesce((SELECT string_agg(surface, '|' ORDER BY n) FROM g WHERE contains(lower(text), lower(surface))), '') AS surfaces FROM documents
    """
)
def seed_glossary(spark, folder):
    docs = dictionary.seed_glossary(table(spark, folder, "documents").select("doc_id", "text"), "text", _GLOSSARY)
    return docs.select("doc_id", F.array_join("glossary.surface", "|").alias("surfaces"))


@query(
    """
    WITH t AS (SELECT DISTINCT split_part(trim(regexp_replace(replace(lower(text), 'ß', 'ss'), '[^a-z0-9가-힣]+', ' ', 'g')), ' ', 1) AS term FROM benchmark),
    d AS (SELECT doc_id, trim(regexp_replace(replace(lower(text), 'ß', 'ss'), '[^a-z0-9가-힣]+', ' ', 'g')) AS norm FROM documents)
    SELECT doc_id, term FROM d JOIN t ON contains(norm, term) WHERE term <> ''
    """
)
def mention_join(spark, folder):
    """Documents that hold a term as a substring; the terms come from a table of any size."""
    first_word = F.split(normalize_match_text("text"), " ")[0]
    terms = table(spark, folder, "benchmark").select(first_word.alias("term")).distinct()
    docs = table(spark, folder, "documents").select("doc_id", normalize_match_text("text").alias("norm"))
    return dictionary.mention_pairs(docs, terms, "doc_id", "norm", "term")


@query(
    """
    WITH t(term) AS (VALUES ('the'), ('tion'), ('MIT License'), ('schule'))
    SELECT doc_id, term, strpos(lower(text), lower(term)) - 1 AS pos FROM documents, t WHERE contains(lower(text), lower(term))
    """
)
def first_mentions(spark, folder):
    terms = ["the", "tion", "MIT License", "schule"]
    found = dictionary.first_mentions(table(spark, folder, "documents"), terms, "doc_id", "text")
    return found.withColumn("pos", F.col("pos").cast("bigint"))


@query(
    """
    WITH g(surface, english, local_form) AS (VALUES ('the', 'The', 'x'), (' MIT License', 'MIT', 'y'), ('cell', 'cell', 'z'), ('tion', '', 'w'), ('und', 'and', ' '), ('that', 'That', 'v'))
    SELECT doc_id, surface FROM documents, g
    WHERE trim(surface) <> '' AND trim(english) <> '' AND trim(local_form) <> '' AND contains(lower(text), lower(trim(surface))) AND surface <> 'cell'
    """
)
def grounded_terms(spark, folder):
    items = [("the", "The", "x"), (" MIT License", "MIT", "y"), ("cell", "cell", "z"), ("tion", "", "w"), ("und", "and", " "), ("that", "That", "v")]
    offered = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(("surface", "english", "local_form"), i)]) for i in items])
    kept = dictionary.grounded_items(offered, "text")
    return table(spark, folder, "documents").select("doc_id", F.explode(kept).alias("g")).select("doc_id", "g.surface")


@query(
    """
    WITH c AS (SELECT DISTINCT sha256(trim(text)) AS digest FROM documents JOIN labels USING (doc_id) WHERE quality = 1)
    SELECT sha256(trim(text)) AS digest, max(length(trim(text))) AS n_chars, count(*) AS n_texts FROM documents
    WHERE length(trim(text)) > 0 AND sha256(trim(text)) NOT IN (SELECT digest FROM c) GROUP BY 1
    """
)
def glossary_worklist(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    reviewed = table(spark, folder, "labels").where("quality = 1").select("doc_id")
    cache = docs.join(reviewed, "doc_id", "left_semi").select(F.sha2(F.trim("text"), 256).alias("digest"))
    work = dictionary.glossary_worklist(docs, "text", cache)
    return work.withColumn("n_chars", F.col("n_chars").cast("bigint"))


# --- taxonomy ------------------------------------------------------------------------------------------------------

PART_RULES = taxonomy.RuleSet(
    facets=("look", "shape", "grade"),
    rules=(
        taxonomy.Rule(("red", "blue"), {"look": ["colour"], "grade": ["tinted"]}),
        taxonomy.Rule(("hot", "cold"), {"look": ["temperature"]}, unless=("rod",)),
        taxonomy.Rule(("old", "cold"), {"look": ["age"]}),
        taxonomy.Rule(("ring", "gear"), {"shape": ["round", "flat"]}),
        taxonomy.Rule(("rod", "bolt"), {"shape": ["long"], "grade": ["steel"]}, also=("promo", "economy")),
    ),
    fallbacks={"shape": (("plate", "flat"), ("anvil", "heavy")), "grade": (("", "plain"),)},
)

_TAGS_SQL = """
    WITH h AS (SELECT p_partkey, p_size, lower(p_name || ' ' || p_type) AS t FROM part),
    f AS (
      SELECT p_partkey, p_size, t,
        list_sort(list_distinct(list_filter([CASE WHEN contains(t, 'red') OR contains(t, 'blue') THEN 'colour' END,
          CASE WHEN (contains(t, 'hot') OR contains(t, 'cold')) AND NOT contains(t, 'rod') THEN 'temperature' END,
          CASE WHEN contains(t, 'old') THEN 'age' END], lambda x: x IS NOT NULL))) AS look,
        list_sort(list_distinct(list_filter([CASE WHEN contains(t, 'ring') OR contains(t, 'gear') THEN 'round' END,
          CASE WHEN contains(t, 'ring') OR contains(t, 'gear') THEN 'flat' END,
          CASE WHEN (contains(t, 'rod') OR contains(t, 'bolt')) AND (contains(t, 'promo') OR contains(t, 'economy')) THEN 'long' END], lambda x: x IS NOT NULL))) AS shape0,
        list_sort(list_distinct(list_filter([CASE WHEN contains(t, 'red') OR contains(t, 'blue') THEN 'tinted' END,
          CASE WHEN (contains(t, 'rod') OR contains(t, 'bolt')) AND (contains(t, 'promo') OR contains(t, 'economy')) THEN 'steel' END], lambda x: x IS NOT NULL))) AS grade0
      FROM h),
    g AS (
      SELECT p_partkey, p_size, look,
        CASE WHEN len(shape0) > 0 THEN shape0 WHEN contains(t, 'plate') THEN ['flat'] WHEN contains(t, 'anvil') THEN ['heavy'] ELSE [] END AS shape,
        CASE WHEN len(grade0) > 0 THEN grade0 ELSE ['plain'] END AS grade
      FROM f)
"""


def _tagged(spark, folder):
    hay = F.lower(F.concat_ws(" ", "p_name", "p_type"))
    return taxonomy.tag_facets(table(spark, folder, "part").select("p_partkey", "p_size", "p_name", "p_type"), hay, PART_RULES)


def _joined(rows, *facets):
    return rows.select("p_partkey", *[F.array_join(f, ",").alias(f) for f in facets])


@query(_TAGS_SQL + "SELECT p_partkey, array_to_string(look, ',') AS look, array_to_string(shape, ',') AS shape, array_to_string(grade, ',') AS grade FROM g")
def tag_rules(spark, folder):
    return _joined(_tagged(spark, folder), *PART_RULES.facets)


_ASSAYS = [
    # name, then purpose, material, core_principle, detection, labeling, output
    ("FACS sorting", "cell_identity", "cell", "cytometry", "fluorescence,light_scatter",
     "antibody,fluorescent_dye,fluorescent_protein,label_free", "population_frequency,single_cell_signal"),
    ("CyTOF", "cell_identity", "cell", "cytometry", "", "antibody", "population_frequency,single_cell_signal"),
    ("RT-qPCR", "detect_quantify", "dna,rna", "amplification", "fluorescence", "fluorescent_dye,nucleic_acid_probe", "abundance"),
    ("nested PCR", "detect_quantify", "dna", "amplification", "", "", "abundance"),
    ("scRNA-seq", "profile_expression", "cell,rna", "sequencing", "sequencing_readout", "", "expression_matrix"),
    ("ATAC-seq", "chromatin_regulation", "chromatin,dna", "sequencing", "sequencing_readout", "", "sequence_accessibility"),
    ("Western blot", "detect_quantify", "protein", "electrophoretic_separation", "chemiluminescence,fluorescence",
     "antibody,enzyme_conjugate", "abundance"),
    ("chromatin immunoprecipitation", "chromatin_regulation,interaction_binding", "chromatin,dna,protein",
     "immunoprecipitation,sequencing", "sequencing_readout", "antibody", "interaction,sequence_accessibility"),
    ("confocal microscopy", "visualize_localize", "cell,protein", "microscopy", "fluorescence,imaging",
     "antibody,fluorescent_dye,fluorescent_protein", "localization"),
    ("CRISPR screen", "perturb_edit", "dna", "genome_editing", "", "", "viability_function"),
    ("protein folding", "detect_quantify", "protein", "", "", "", ""),
    ("weighing", "detect_quantify", "", "", "", "", ""),
]
_ASSAY_VALUES = ", ".join("(" + str(i) + ", " + ", ".join(f"'{v}'" for v in a) + ")" for i, a in enumerate(_ASSAYS))


@query(
    f"""
    WITH a(i, name, purpose, material, core_principle, detection, labeling, output) AS (VALUES {_ASSAY_VALUES})
    SELECT p_partkey, purpose, material, core_principle, detection, labeling, output FROM part JOIN a ON i = p_size % {len(_ASSAYS)}
    """
)
def assay_facets(spark, folder):
    """The assay rules on method names spread over the part table."""
    names = F.array(*[F.lit(a[0]) for a in _ASSAYS])
    none = F.array().cast("array<string>")
    methods = table(spark, folder, "part").select(
        "p_partkey", F.element_at(names, (F.col("p_size") % len(_ASSAYS) + 1).cast("int")).alias("name"),
        F.lit(None).cast("string").alias("category"), F.lit("").alias("parent_method"), none.alias("aliases"), none.alias("submethods"),
    )
    hay = taxonomy.method_haystack("name", "category", "parent_method", "aliases", "submethods")
    return _joined(taxonomy.tag_facets(methods, hay), *taxonomy.FACETS)


@query(
    _TAGS_SQL
    + """
    , u AS (SELECT 'look' AS facet, unnest(look) AS value FROM g UNION ALL SELECT 'shape', unnest(shape) FROM g UNION ALL SELECT 'grade', unnest(grade) FROM g)
    SELECT facet, value, count(*) AS n_methods FROM u GROUP BY ALL
    """
)
def facet_counts(spark, folder):
    return taxonomy.facet_counts(_tagged(spark, folder), "p_partkey", PART_RULES.facets)


@query(_TAGS_SQL + "SELECT p_partkey FROM g WHERE (list_contains(look, 'colour') OR list_contains(look, 'age')) AND list_contains(shape, 'flat')")
def facet_filter(spark, folder):
    picked = {"look": ["colour", "age"], "shape": ["flat"], "grade": []}
    return taxonomy.filter_facets(_tagged(spark, folder), picked).select("p_partkey")


@query(
    _TAGS_SQL
    + """
    SELECT p_partkey, CASE WHEN p_size % 3 = 2 THEN 'stored' ELSE array_to_string(look, ',') END AS look, array_to_string(shape, ',') AS shape,
      CASE WHEN p_size % 3 = 2 AND p_size % 2 = 0 THEN 'A,B' ELSE array_to_string(grade, ',') END AS grade
    FROM g
    """
)
def overlay_facets(spark, folder):
    """Stored lists of the current version win where they are not empty; version 1 and empty lists do not."""
    graded = F.when(F.col("p_size") % 2 == 0, F.array(F.lit("A"), F.lit("B"))).otherwise(F.array().cast("array<string>"))
    stored = table(spark, folder, "part").select(
        "p_partkey",
        (F.col("p_size") % 3).cast("int").alias("taxonomy_version"),
        F.create_map(F.lit("look"), F.array(F.lit("stored")), F.lit("grade"), graded).alias("facets"),
    )
    merged = taxonomy.overlay_facets(_tagged(spark, folder), stored, "p_partkey", PART_RULES.facets)
    return _joined(merged, *PART_RULES.facets)


# --- search --------------------------------------------------------------------------------------------------------


def _methods(spark, folder):
    grouped = table(spark, folder, "part").groupBy(F.initcap("p_name").alias("name")).agg(
        F.max("p_brand").alias("b"), F.min("p_type").alias("category"), F.max("p_type").alias("parent_method")
    )
    alias = F.concat(F.element_at(F.split("name", " "), 2), F.lit("-"), "b")
    return grouped.select("name", F.array(alias, F.col("b")).alias("aliases"), "category", "parent_method")


_QUERIES = ["Red_Ring", "ring brand#9", "red", "gear-", "brand#9", "ring", "ECONOMY", "nothing here", " "]


@query(
    """
    WITH m AS (SELECT upper(p_name[1]) || substr(split_part(p_name, ' ', 1), 2) || ' ' || upper(split_part(p_name, ' ', 2)[1]) || substr(split_part(p_name, ' ', 2), 2) AS name,
        max(p_brand) AS b, min(p_type) AS category, max(p_type) AS parent FROM part GROUP BY p_name),
    n AS (SELECT name, lower(name) AS nn, lower(split_part(name, ' ', 2)) || ' ' || lower(b) AS a1, lower(b) AS a2,
            lower(name || ' ' || split_part(name, ' ', 2) || '-' || b || ' ' || b || ' ' || category || ' ' || parent) AS blob FROM m),
    q(query, q) AS (VALUES ('Red_Ring', 'red ring'), ('ring brand#9', 'ring brand#9'), ('red', 'red'), ('gear-', 'gear'), ('brand#9', 'brand#9'), ('ring', 'ring'),
      ('ECONOMY', 'economy'), ('nothing here', 'nothing here')),
    s AS (SELECT query, name, CAST(CASE WHEN nn = q THEN 0 WHEN a1 = q OR a2 = q THEN 1 WHEN starts_with(nn, q) THEN 2 WHEN starts_with(a1, q) OR starts_with(a2, q) THEN 3
            WHEN contains(nn, q) THEN 4 WHEN contains(blob, q) THEN 5 END AS INT) AS tier FROM n, q)
    SELECT query, name, tier, CAST(row_number() OVER (PARTITION BY query ORDER BY tier, lower(name), name) AS INT) AS rank FROM s WHERE tier IS NOT NULL QUALIFY rank <= 20
    """
)
def rank_search(spark, folder):
    return search.rank_matches(_methods(spark, folder), _QUERIES)


@query(
    r"""
    WITH m AS (SELECT upper(p_name[1]) || substr(split_part(p_name, ' ', 1), 2) || ' ' || upper(split_part(p_name, ' ', 2)[1]) || substr(split_part(p_name, ' ', 2), 2) AS name,
        max(p_brand) AS b, min(p_type) AS category, max(p_type) AS parent FROM part GROUP BY p_name),
    n AS (SELECT name, lower(name) AS nn, lower(split_part(name, ' ', 2)) || ' ' || lower(b) AS a1, lower(b) AS a2,
            lower(name || ' ' || split_part(name, ' ', 2) || '-' || b || ' ' || b || ' ' || category || ' ' || parent) AS blob FROM m),
    q AS (SELECT DISTINCT query, trim(regexp_replace(lower(query), '[\s_/-]+', ' ', 'g')) AS q FROM (
        SELECT p_name AS query FROM part UNION SELECT upper(left(p_name, CAST(1 + p_size % 7 AS INT))) FROM part UNION SELECT substr(p_name, 2, CAST(1 + p_partkey % 5 AS INT)) FROM part
        UNION SELECT p_brand FROM part UNION SELECT right(p_type, 3) || '_' FROM part)),
    s AS (SELECT query, name, CAST(CASE WHEN nn = q THEN 0 WHEN a1 = q OR a2 = q THEN 1 WHEN starts_with(nn, q) THEN 2 WHEN starts_with(a1, q) OR starts_with(a2, q) THEN 3
            WHEN contains(nn, q) THEN 4 WHEN contains(blob, q) THEN 5 END AS INT) AS tier FROM n, q WHERE q <> '')
    SELECT query, name, tier, CAST(row_number() OVER (PARTITION BY query ORDER BY tier, lower(name), name) AS INT) AS rank FROM s WHERE tier IS NOT NULL QUALIFY rank <= 20
    """
)
def rank_search_table(spark, folder):
    """The ranked search for a table of queries: names, beginnings and inner parts of names in other cases, brands, ends of types."""
    part = table(spark, folder, "part")
    asked = [
        F.col("p_name"), F.upper(F.left("p_name", 1 + F.col("p_size") % 7)), F.substring("p_name", F.lit(2), (1 + F.col("p_partkey") % 5).cast("int")),
        F.col("p_brand"), F.concat(F.right("p_type", F.lit(3)), F.lit("_")),
    ]
    queries = part.select(F.explode(F.array(*asked)).alias("query"))
    return search.rank_matches_table(_methods(spark, folder), queries)


@query("SELECT DISTINCT p_name AS name FROM part ORDER BY lower(p_name), p_name")
def sorted_names(spark, folder):
    return search.by_name(table(spark, folder, "part").select(F.col("p_name").alias("name")).distinct(), "name")


@query(
    """
    WITH f AS (SELECT DISTINCT CASE WHEN p_size % 5 = 0 THEN p_type ELSE 'Fig. ' || p_size || CASE WHEN p_size % 2 = 0 THEN chr(CAST(65 + p_partkey % 3 AS INT)) ELSE '' END END AS label FROM part)
    SELECT label, CASE WHEN regexp_extract(label, '([0-9]+)', 1) = '' THEN 9999 ELSE CAST(regexp_extract(label, '([0-9]+)', 1) AS INT) END AS number,
      lower(regexp_extract(label, '([0-9]+)([A-Za-z]?)', 2)) AS suffix FROM f ORDER BY number, suffix, label
    """
)
def figure_order(spark, folder):
    """Distinct labels in figure order, with their sort keys."""
    size = F.col("p_size")
    letter = F.when(size % 2 == 0, F.char(F.lit(65) + F.col("p_partkey") % 3)).otherwise("")
    label = F.when(size % 5 == 0, F.col("p_type")).otherwise(F.concat(F.lit("Fig. "), size, letter))
    labels = search.by_figure(table(spark, folder, "part").select(label.alias("label")).distinct(), "label")
    number = F.coalesce(figure_number("label"), F.lit(9999))
    return labels.select("label", number.alias("number"), F.lower(F.regexp_extract("label", r"(\d+)([A-Za-z]?)", 2)).alias("suffix"))


@query(
    """
    SELECT l_suppkey, l_partkey, l_extendedprice, CAST(row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_partkey, l_orderkey, l_linenumber) AS INT) AS rank
    FROM lineitem QUALIFY rank <= 4
    """
)
def top_k_per_group(spark, folder):
    lines = table(spark, folder, "lineitem").select("l_suppkey", "l_partkey", "l_extendedprice", "l_orderkey", "l_linenumber")
    order = [F.desc("l_extendedprice"), F.asc("l_partkey"), F.asc("l_orderkey"), F.asc("l_linenumber")]
    return top_k(lines, ["l_suppkey"], order, 4, rank="rank").drop("l_orderkey", "l_linenumber")


@query(
    """
    WITH w AS (SELECT conv_id, turn, unnest(string_split(text, ' ')) AS w, generate_subscripts(string_split(text, ' '), 1) AS i FROM conversations),
    o AS (SELECT *, CASE WHEN w LIKE '%e%' THEN length(w) ELSE 999 END AS o FROM w)
    SELECT conv_id, turn, sha256(string_agg(w, ' ' ORDER BY o, i)) AS path_hash FROM o GROUP BY ALL
    """
)
def ordered_items(spark, folder):
    """Words of a turn as items of a path; words without an order go last."""
    items = F.transform(
        F.split("text", " "), lambda w: F.struct(F.when(F.contains(w, F.lit("e")), F.length(w)).alias("order"), w.alias("w"))
    )
    path = F.array_join(F.transform(search.ordered_path(items), lambda x: x["w"]), " ")
    return table(spark, folder, "conversations").select("conv_id", "turn", F.sha2(path, 256).alias("path_hash"))


def _links(spark, folder):
    """(paper, method) links: the brands of the parts of an order."""
    parts = table(spark, folder, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("method"))
    lines = table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("paper"), "l_partkey", "l_linenumber", "l_returnflag")
    return lines.join(parts, "l_partkey")


@query(
    """
    SELECT p_brand AS method, count(DISTINCT l_orderkey) AS paper_count, count(*) AS figure_count FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1
    """
)
def entity_stats(spark, folder):
    return search.method_stats(_links(spark, folder), "method", "paper")


_CO_SQL = """
    WITH l AS (SELECT DISTINCT l_orderkey, p_brand FROM lineitem JOIN part ON p_partkey = l_partkey),
    c AS (SELECT a.p_brand AS method_a, b.p_brand AS method_b, count(*) AS paper_count FROM l a JOIN l b ON a.l_orderkey = b.l_orderkey AND a.p_brand < b.p_brand GROUP BY ALL)
"""


@query(_CO_SQL + "SELECT * FROM c")
def co_usage(spark, folder):
    return search.co_usage(_links(spark, folder), "paper", "method")


@query(
    _CO_SQL
    + """
    , b AS (SELECT method_a AS method, method_b AS co_method, paper_count FROM c UNION ALL SELECT method_b, method_a, paper_count FROM c)
    SELECT *, CAST(row_number() OVER (PARTITION BY method ORDER BY paper_count DESC, co_method) AS INT) AS rank FROM b QUALIFY rank <= 4
    """
)
def top_co_used(spark, folder):
    return search.top_co_used(co_usage(spark, folder))


@query(
    """
    SELECT p_brand AS method, l_returnflag = 'A' AS has_image, l_orderkey AS paper_pos, CAST(l_linenumber AS BIGINT) * 1000000 + l_partkey AS figure_pos FROM lineitem JOIN part ON p_partkey = l_partkey
    QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY l_returnflag <> 'A', l_orderkey, l_linenumber, l_partkey) = 1
    """
)
def representative(spark, folder):
    figures = _links(spark, folder).select(
        "method", (F.col("l_returnflag") == "A").alias("has_image"), F.col("paper").alias("paper_pos"),
        (F.col("l_linenumber").cast("bigint") * 1_000_000 + F.col("l_partkey")).alias("figure_pos"),
    )
    return search.representative_figure(figures, ["method"])


# --- nested corpus -------------------------------------------------------------------------------------------------


@query(
    """
    WITH l AS (SELECT doc_id, source, lang, unnest(string_split(text, chr(10))) AS caption, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS figure_pos FROM documents)
    SELECT source || '-' || doc_id AS name, CAST(0 AS INT) AS paper_pos, 'PMC' || doc_id AS pmcid, CAST(figure_pos AS INT) AS figure_pos, 'Fig. ' || figure_pos AS figure, sha256(caption) AS caption_hash FROM l
    """
)
def flatten_profiles(spark, folder):
    """Method profiles as nested JSON records, parsed with the fixed schema and flattened to figures."""
    flat = profiles.method_figures(_profiles(spark, folder))
    return flat.withColumn("caption_hash", F.sha2("caption", 256)).drop("caption")


def _profiles(spark, folder):
    figures = F.transform(
        F.split("text", "\n"), lambda t, i: F.struct(F.concat(F.lit("Fig. "), i.cast("string")).alias("figure"), t.alias("caption"))
    )
    paper = F.struct(F.concat(F.lit("PMC"), "doc_id").alias("pmcid"), F.col("source").alias("title"), figures.alias("figures"))
    body = F.to_json(
        F.struct(
            F.concat_ws("-", "source", F.col("doc_id").cast("string")).alias("name"),
            F.when(F.col("lang") != "fr", F.array("lang", "source")).alias("aliases"),
            F.array(paper).alias("papers"),
        )
    )
    return profiles.parse_profiles(table(spark, folder, "documents").select(body.alias("body")), "body")


@query(
    """
    WITH n AS (SELECT source || '-' || doc_id AS canonical, lang, source FROM documents)
    SELECT canonical AS alias, canonical, 0 AS pos FROM n UNION ALL SELECT lang, canonical, 1 FROM n WHERE lang <> 'fr' UNION ALL SELECT source, canonical, 2 FROM n WHERE lang <> 'fr'
    """
)
def flatten_terms(spark, folder):
    return profiles.method_terms(_profiles(spark, folder))


@query(
    """
    SELECT 'PMC' || page_id AS pmcid, 'Fig. 1' AS figure, url AS href FROM pages UNION ALL SELECT 'PMC' || page_id, 'Fig. 2', split_part(url, '/', 3) FROM pages WHERE page_id % 2 = 0
    """
)
def flatten_images(spark, folder):
    """Image index as a nested JSON object per row; figures without a link vanish."""
    second = F.when(F.col("page_id") % 2 == 0, F.element_at(F.split("url", "/"), 3)).otherwise("")
    inner = F.create_map(F.lit("Fig. 1"), F.struct(F.col("url").alias("href")), F.lit("Fig. 2"), F.struct(second.alias("href")))
    body = F.to_json(F.create_map(F.concat(F.lit("PMC"), F.col("page_id")), inner))
    rows = table(spark, folder, "pages").select(F.from_json(body, profiles.IMAGE_INDEX).alias("index"))
    return profiles.flatten_image_index(rows, "index")


# --- captions and panels -------------------------------------------------------------------------------------------


def _captions(spark, folder):
    sep = F.element_at(F.array(*[F.lit(s) for s in ("-", " and ", " to ")]), (F.col("p_size") % 3 + 1).cast("int"))
    caption = F.concat(
        F.lit(" "), "p_type", F.lit(" overview of "), "p_name", F.lit(". (A) the "), "p_name", F.lit(" x. (B"), sep, F.lit("C) "), "p_brand",
        F.lit("; (C-A) lost (D, F) none (a) of it."),
    )
    return spread(table(spark, folder, "part")).withColumn("caption", caption)


@query(
    """
    WITH c AS (SELECT p_partkey, p_type || ' overview of ' || p_name || '.' AS preamble, ['-', ' and ', ' to '][CAST(p_size % 3 + 1 AS INT)] AS sep, p_name, p_brand FROM part)
    SELECT p_partkey, preamble, 0 AS pos, 'A' AS labels, 'A' AS raw_label, 'the ' || p_name || ' x' AS text FROM c
    UNION ALL SELECT p_partkey, preamble, 1, 'B,C', 'B' || sep || 'C', p_brand FROM c
    UNION ALL SELECT p_partkey, preamble, 2, 'D,F', 'D, F', 'none (a) of it' FROM c
    """
)
def split_panels(spark, folder):
    rows = panels.split_panels(_captions(spark, folder), ["p_partkey"])
    return rows.withColumn("labels", F.array_join("labels", ","))


def _usage(spark, folder):
    kind = F.col("p_size") % 4
    linked = _captions(spark, folder).withColumns(
        {
            "method": F.when(kind == 0, F.col("p_name")).when(kind == 1, F.upper("p_brand")).when(kind == 2, F.lit("zebra")).otherwise(F.lit("Lost")),
            "aliases": F.when(kind == 3, F.array(F.lit("none"), F.lit("NONE "))),
            "figure": F.concat(F.lit("figure "), F.col("p_size")),
        }
    )
    return panels.panel_usage(linked.withColumn("terms", panels.match_terms("method", "aliases")))


_USAGE_SQL = """
    WITH u AS (
      SELECT p_partkey, p_brand, p_size, CASE p_size % 4 WHEN 2 THEN 'linked_only' ELSE 'panel_map' END AS mode,
        CASE p_size % 4 WHEN 0 THEN 'A:explicit|BC:figure_context|DF:figure_context' WHEN 1 THEN 'BC:explicit' WHEN 2 THEN '' ELSE 'DF:explicit' END AS usages,
        'A,B,C,D,F' AS all_panels,
        CASE p_size % 4 WHEN 0 THEN 'A,B,C,D,F' WHEN 1 THEN 'B-C' WHEN 2 THEN '' ELSE 'D,F' END AS used
      FROM part)
"""


@query(_USAGE_SQL + "SELECT p_partkey, mode, usages, all_panels FROM u")
def panel_usage(spark, folder):
    listed = F.transform("usages", lambda u: F.concat(F.array_join(u["labels"], ""), F.lit(":"), u["status"]))
    return _usage(spark, folder).select(
        "p_partkey", "mode", F.array_join(listed, "|").alias("usages"), F.array_join("all_panels", ",").alias("all_panels")
    )


@query(_USAGE_SQL + "SELECT p_partkey, 'Fig. ' || p_size || used AS header FROM u")
def figure_panel_index(spark, folder):
    return _usage(spark, folder).select("p_partkey", panels.figure_panel_text().alias("header"))


@query(
    _USAGE_SQL
    + """
    , h AS (SELECT p_brand, 'Fig. ' || p_size || used AS header, min(p_partkey) AS pos FROM u GROUP BY ALL),
    l AS (SELECT p_brand, list(header ORDER BY pos) AS l FROM h GROUP BY 1)
    SELECT p_brand, CAST(len(l) AS INT) AS n_labels, CASE WHEN len(l) <= 5 THEN array_to_string(l, ', ') ELSE array_to_string(l[1:5], ', ') || ' +' || (len(l) - 5) || ' more' END AS panel_index
    FROM l
    """
)
def paper_panel_index(spark, folder):
    """Headers of all figures of a paper (here: a brand), first five shown."""
    return panels.paper_panel_index(_usage(spark, folder), ["p_brand"], "p_partkey")


@query(
    """
    WITH c AS (SELECT p_partkey, 65 + p_partkey % 8 AS a, 65 + p_size % 8 AS b, p_size % 3 AS k FROM part)
    SELECT p_partkey, CAST(CASE WHEN k = 2 THEN 1 WHEN a <= b THEN b - a + 1 ELSE 2 END AS INT) AS panel_count FROM c
    """
)
def panel_count(spark, folder):
    from corpuskit.functions.labels import panel_count as count_panels

    first, last = (F.char(F.lit(65) + F.col(c) % 8) for c in ("p_partkey", "p_size"))
    sep = F.element_at(F.array(F.lit("-"), F.lit(" and ")), (F.col("p_size") % 3 + 1).cast("int"))
    inside = F.when(F.col("p_size") % 3 == 2, first).otherwise(F.concat(first, sep, last))
    caption = F.concat(F.lit("Zoo ( "), inside, F.lit(" ) zoo"))
    return table(spark, folder, "part").select("p_partkey", count_panels(caption).alias("panel_count"))


@query(
    """
    SELECT source, doc_id, n_chars FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY length(text) + CASE WHEN contains(text, 'MIT License') THEN 300 ELSE 0 END DESC, doc_id) = 1
    """
)
def best_per_key(spark, folder):
    """Richest text per source: length plus a bonus, first one on ties."""
    score = F.length("text") + F.when(F.contains("text", F.lit("MIT License")), 300).otherwise(0)
    docs = table(spark, folder, "documents").select("source", "doc_id", "n_chars", score.alias("score"))
    return best_rows(docs, ["source"], [F.desc("score"), F.asc("doc_id")]).drop("score")
