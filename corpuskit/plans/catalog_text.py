"""Catalogue: scalar text functions over whole tables."""

from __future__ import annotations

from html import _invalid_charrefs, _invalid_codepoints
from html.entities import html5

from pyspark.sql import functions as F

from corpuskit.functions import labels as L
from corpuskit.functions import sentences as S
from corpuskit.functions import text as X
from corpuskit.functions.notes import annotate_texts
from corpuskit.functions.python_udfs import casefold_text, nfkc_text, protect_terms_text, restore_text
from corpuskit.operators import keyed, records, search
from corpuskit.operators.dictionary import seed_glossary
from corpuskit.operators.ordered import bundle_by_length
from corpuskit.operators.taxonomy import FACET_VALUES, facet_label
from corpuskit.plans import rewriting
from corpuskit.plans.registry import query
from corpuskit.sources.tables import table

DOC_SQUEEZED = r"trim(regexp_replace(text, '\s+', ' ', 'g'))"
DOC_STRIPPED = r"regexp_replace(regexp_replace(text, '^\s+', ''), '\s+$', '')"


@query(
    r"""
    WITH raw AS (
      SELECT p_partkey, ' "' || upper(p_name) || chr(9) || ' ' || repeat(p_type || ' ', p_size) || chr(10) || '(' || p_brand || ').; ' AS raw
      FROM part),
    s AS (SELECT p_partkey, trim(regexp_replace(raw, '\s+', ' ', 'g')) AS s FROM raw)
    SELECT p_partkey, 'identification of dna ' || lower(trim(s, ' .,;:!?()[]{}"''`')) AS norm, 'Identification of DNA ' || s AS clean, s AS term
    FROM s
    """
)
def norm_concept(spark, folder):
    raw = F.concat(
        F.lit(' "'), F.upper("p_name"), F.lit("\t "), F.repeat(F.concat("p_type", F.lit(" ")), F.col("p_size")),
        F.lit("\n("), "p_brand", F.lit(").; "),
    )
    return table(spark, folder, "part").select(
        "p_partkey",
        X.normalize_concept(F.concat(F.lit(" Identi\ufb01cation of \uff24\uff2e\uff21 "), F.btrim(raw, F.lit(X.CONCEPT_EDGE_CHARS)))).alias("norm"),
        X.clean_concept(F.concat(F.lit(" Identi\ufb01cation of \uff24\uff2e\uff21 "), raw)).alias("clean"),
        X.single_term(raw).alias("term"),
    )


@query(
    r"""
    SELECT p_partkey, trim(regexp_replace(lower(p_type || '_' || p_brand || ' / ' || replace(p_name, ' ', '-') || '  X'), '[\s_\-/]+', ' ', 'g')) AS norm
    FROM part
    """
)
def norm_method(spark, folder):
    raw = F.concat(
        "p_type", F.lit("_"), "p_brand", F.lit(" / "), F.replace("p_name", F.lit(" "), F.lit("-")), F.lit("  X")
    )
    return table(spark, folder, "part").select("p_partkey", X.normalize_method_name(raw).alias("norm"))


@query(
    """
    SELECT doc_id, sha256(trim(regexp_replace(replace(lower(text), 'ß', 'ss'), '[^a-z0-9가-힣]+', ' ', 'g'))) AS norm_hash
    FROM documents
    """
)
def norm_match(spark, folder):
    docs = table(spark, folder, "documents")
    return docs.select("doc_id", F.sha2(X.normalize_match_text("text"), 256).alias("norm_hash"))


@query(
    """
    WITH t AS (
      SELECT doc_id, list_transform(string_split(text, chr(10)),
               lambda l: trim(regexp_replace(replace(lower('Identification of DNA ' || l), 'ß', 'ss'), '[^a-z0-9]+', ' ', 'g'))) AS titles
      FROM documents)
    SELECT doc_id, sha256(array_to_string(titles, '|')) AS norm_hash,
           CAST(len(list_filter(titles, lambda x: length(x) >= 35 AND len(string_split(x, ' ')) >= 5)) AS BIGINT) AS n_credible
    FROM t
    """
)
def norm_title(spark, folder):
    from corpuskit.operators.identity import is_credible_title

    lines = F.transform(F.split("text", "\n"), lambda t: F.concat(F.lit("Identi\ufb01cation of \uff24\uff2e\uff21 "), t))
    titles = F.transform(X.mapped(lines, lambda joined: casefold_text(nfkc_text(joined))), lambda t: X.normalize_title(t, unicode=False))
    docs = table(spark, folder, "documents").select("doc_id", titles.alias("titles"))
    return docs.select(
        "doc_id",
        F.sha2(F.array_join("titles", "|"), 256).alias("norm_hash"),
        F.size(F.filter("titles", is_credible_title)).cast("bigint").alias("n_credible"),
    )


# The decoding rule of HTML stated over Python's own table of names: numbers, names, and the longest of the old names that need no semicolon.
_ENTITY_NAMES = ", ".join("('" + name + "', '" + "'||'".join(f"'||chr({ord(c)})||'" for c in value) + "')" for name, value in html5.items()).replace("''||", "").replace("||''", "")
_NUMBER_NAMES = ", ".join(f"({code}, chr({ord(value)}))" for code, value in _invalid_charrefs.items() if value)
_NO_CHARACTERS = ", ".join(str(code) for code in sorted(_invalid_codepoints))
_WS_RE2 = r"[\s\x0B\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


@query(
    rf"""
    WITH names AS (SELECT map_from_entries(list((n, v))) AS m FROM (VALUES {_ENTITY_NAMES}) AS e(n, v)),
    numbers AS (SELECT map_from_entries(list((n, v))) AS k FROM (VALUES {_NUMBER_NAMES}) AS e(n, v)),
    pieces AS (SELECT page_id, unnest(string_split(coalesce(html, ''), '&')) AS piece, generate_subscripts(string_split(coalesce(html, ''), '&'), 1) AS i FROM pages),
    refs AS (SELECT *, regexp_extract(piece, '^(#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <#;]{{1,32}};?)') AS ref FROM pieces),
    digits AS (SELECT *, CASE WHEN regexp_matches(ref, '^#[0-9]') THEN ltrim(rtrim(substr(ref, 2), ';'), '0') END AS dec, CASE WHEN regexp_matches(ref, '^#[xX]') THEN ltrim(rtrim(substr(ref, 3), ';'), '0') END AS hex FROM refs),
    codes AS (SELECT *, CASE WHEN coalesce(dec, hex) IS NULL THEN NULL WHEN length(coalesce(dec, hex)) > 8 THEN 1114112 WHEN coalesce(dec, hex) = '' THEN 0 ELSE least(coalesce(TRY_CAST(dec AS BIGINT), TRY_CAST('0x' || hex AS BIGINT)), 1114112) END::INT AS code FROM digits),
    decoded AS (SELECT page_id, i, CASE WHEN i = 1 THEN piece WHEN ref = '' THEN '&' || piece
        WHEN code IS NOT NULL THEN CASE WHEN k[code] IS NOT NULL THEN k[code] WHEN code BETWEEN 55296 AND 57343 OR code > 1114111 THEN chr(65533) WHEN code IN ({_NO_CHARACTERS}) THEN '' ELSE chr(code) END
        ELSE coalesce(m[ref], m[left(ref, 6)] || substr(ref, 7), m[left(ref, 5)] || substr(ref, 6), m[left(ref, 4)] || substr(ref, 5), m[left(ref, 3)] || substr(ref, 4), m[left(ref, 2)] || substr(ref, 3), '&' || ref)
        END || CASE WHEN i = 1 OR ref = '' THEN '' ELSE substr(piece, length(ref) + 1) END AS part FROM codes, names, numbers),
    whole AS (SELECT page_id, string_agg(part, '' ORDER BY i) AS html FROM decoded GROUP BY 1)
    SELECT page_id, sha256(trim(regexp_replace(regexp_replace(replace(html, chr(0), ' '), '-{_WS_RE2}*\n{_WS_RE2}*', '', 'g'), '{_WS_RE2}+', ' ', 'g'))) AS clean_hash FROM whole
    """
)
def clean_pages(spark, folder):
    return table(spark, folder, "pages").select("page_id", F.sha2(X.clean_text("html"), 256).alias("clean_hash"))


@query(
    r"""
    SELECT doc_id, sha256(trim(regexp_replace(regexp_replace(replace(text, 'th ', 'th- ' || chr(10) || ' '), '-\s*\n\s*', '', 'g'), '\s+', ' ', 'g'))) AS clean_hash
    FROM documents
    """
)
def join_hyphens(spark, folder):
    cut = F.replace("text", F.lit("th "), F.lit("th- \n "))
    return table(spark, folder, "documents").select("doc_id", F.sha2(X.join_hyphenated(cut), 256).alias("clean_hash"))


@query(
    """
    SELECT o_orderkey,
           CASE CAST(o_orderkey % 5 AS INT)
             WHEN 0 THEN '10.1000/ord(' || o_orderkey || ')'
             WHEN 1 THEN '10.1000/ord' || o_orderkey
             WHEN 2 THEN '10.1000/[a]ord' || o_orderkey
             WHEN 3 THEN '10.1000/ord' || o_orderkey
             ELSE '' END AS doi
    FROM orders
    """
)
def clean_dois(spark, folder):
    key = F.col("o_orderkey").cast("string")
    raw = (
        F.when(F.col("o_orderkey") % 5 == 0, F.concat(F.lit("https://doi.org/10.1000/Ord("), key, F.lit(")).,")))
        .when(F.col("o_orderkey") % 5 == 1, F.concat(F.lit(" DOI: 10.1000/ORD"), key, F.lit("))")))
        .when(F.col("o_orderkey") % 5 == 2, F.concat(F.lit("http://dx.doi.org/10.1000/[A]ord"), key, F.lit("]]")))
        .when(F.col("o_orderkey") % 5 == 3, F.concat(F.lit("10.1000/ord"), key, F.lit(".;:")))
    )
    return table(spark, folder, "orders").select("o_orderkey", X.clean_doi(raw).alias("doi"))


def _figure_labels(spark, folder):
    size, kind = F.col("p_size").cast("string"), F.col("p_partkey") % 6
    raw = (
        F.when(kind == 0, F.concat(F.lit(" Figure "), size, F.lit("A. ")))
        .when(kind == 1, F.concat(F.lit("fig "), size))
        .when(kind == 2, F.concat(F.lit("Fig. S"), size))
        .when(kind == 3, F.concat(F.lit("Table "), size))
        .when(kind == 4, F.concat(F.lit("see FIGURE"), size, F.lit("b here")))
        .otherwise(F.lit(""))
    )
    return table(spark, folder, "part").select("p_partkey", "p_size", raw.alias("raw"))


@query(
    """
    SELECT p_partkey,
      CASE CAST(p_partkey % 6 AS INT) WHEN 0 THEN 'Fig. ' || p_size || 'A' WHEN 1 THEN 'Fig. ' || p_size WHEN 2 THEN 'Fig. S' || p_size
        WHEN 3 THEN 'Table ' || p_size WHEN 4 THEN 'see FIGURE' || p_size || 'b here' ELSE '' END AS card_label,
      CASE CAST(p_partkey % 6 AS INT) WHEN 0 THEN 'Fig. ' || p_size || 'A' WHEN 1 THEN 'Fig. ' || p_size WHEN 2 THEN 'Fig. S' || p_size
        WHEN 3 THEN 'Table ' || p_size WHEN 4 THEN 'Fig. ' || p_size || 'b' ELSE '' END AS searched_label,
      CASE CAST(p_partkey % 6 AS INT) WHEN 0 THEN 'Fig. ' || p_size || 'A' WHEN 1 THEN 'Fig. ' || p_size
        WHEN 4 THEN 'Fig. ' || p_size || 'b' ELSE '' END AS caption_label
    FROM part
    """
)
def figure_label(spark, folder):
    return _figure_labels(spark, folder).select(
        "p_partkey",
        L.figure_label_prefix("raw").alias("card_label"),
        L.figure_label_search("raw").alias("searched_label"),
        L.figure_label_caption("raw").alias("caption_label"),
    )


@query(
    """
    SELECT p_partkey,
      CASE CAST(p_partkey % 6 AS INT) WHEN 0 THEN 'fig' || p_size || 'a' WHEN 1 THEN 'fig' || p_size WHEN 2 THEN 'figs' || p_size
        WHEN 3 THEN 'table' || p_size WHEN 4 THEN 'fig' || p_size || 'b' ELSE '' END AS label_key,
      CASE CAST(p_partkey % 6 AS INT) WHEN 0 THEN 'fig' || p_size || 'a' WHEN 1 THEN 'fig' || p_size WHEN 2 THEN 'fig' || p_size
        WHEN 3 THEN 'fig' || p_size WHEN 4 THEN 'fig' || p_size || 'b' ELSE '' END AS any_key,
      CASE WHEN p_partkey % 6 < 5 THEN 'fig' || p_size END AS integer_key,
      CASE CAST(p_partkey % 6 AS INT) WHEN 5 THEN NULL WHEN 2 THEN NULL WHEN 3 THEN NULL ELSE 'fig' || p_size END AS base_key
    FROM part
    """
)
def figure_key(spark, folder):
    key = L.figure_label_key("raw")
    return _figure_labels(spark, folder).select(
        "p_partkey",
        key.alias("label_key"),
        L.figure_any_key("raw").alias("any_key"),
        L.figure_integer_key(L.figure_number("raw")).alias("integer_key"),
        L.figure_base_key(key).alias("base_key"),
    )


@query(
    rf"""
    WITH s AS (SELECT doc_id, {DOC_SQUEEZED} AS s FROM documents)
    SELECT doc_id, CASE WHEN length(s) <= 360 THEN s ELSE regexp_replace(substr(s, 1, 360), ' [^ ]*$', '') || '…' END AS short
    FROM s
    """
)
def concise_text(spark, folder):
    return table(spark, folder, "documents").select("doc_id", X.concise_text("text").alias("short"))


@query(
    """
    WITH p AS (SELECT doc_id, text, strpos(lower(text), 'tion') - 1 AS pos FROM documents)
    SELECT doc_id, CASE WHEN pos < 0 THEN sha256(text)
      ELSE sha256(substr(text, greatest(0, pos - 250) + 1, least(length(text), pos + 4 + 450) - greatest(0, pos - 250))) END AS snippet_hash
    FROM p
    """
)
def keyword_snippet(spark, folder):
    snippet = X.keyword_snippet("text", "tion")
    return table(spark, folder, "documents").select("doc_id", F.sha2(snippet, 256).alias("snippet_hash"))


# The cut of the reference list: the first line with nothing but such a word, from the first blank line in front of it, if that lies beyond 55 % of the stripped text.
_WS_SQL = "||".join(f"chr({ord(c)})" for c in X.WS_CHARS)
_HEADING_RE2 = f"^{_WS_RE2}*({'|'.join(''.join(f'[{c.upper()}{c}]' for c in word) for word in ('references', 'bibliography'))}){_WS_RE2}*$"


@query(
    rf"""
    WITH d AS (SELECT doc_id, coalesce(trim(trim(text, {_WS_SQL}) || chr(10) || chr(10) || ' References ' || chr(10) || source, {_WS_SQL}), '') AS t FROM (SELECT doc_id, coalesce(text, '') AS text, source FROM documents)),
    l AS (SELECT doc_id, t, string_split(t, chr(10)) AS lines FROM d),
    h AS (SELECT doc_id, t, lines, list_filter(list_transform(lines, lambda x, i: CASE WHEN regexp_matches(x, '{_HEADING_RE2}') THEN i END), lambda i: i IS NOT NULL) AS heads,
      list_filter(list_transform(lines, lambda x, i: CASE WHEN trim(x, {_WS_SQL}) <> '' THEN i END), lambda i: i IS NOT NULL) AS filled FROM l),
    s AS (SELECT doc_id, t, lines, list_transform(heads, lambda i: coalesce(list_max(list_filter(filled, lambda j: j < i)), 0)) AS before FROM h),
    p AS (SELECT doc_id, t, list_transform(before, lambda k: CASE WHEN k = 0 THEN 0 ELSE length(array_to_string(lines[1:k], chr(10))) + 1 END) AS starts FROM s),
    c AS (SELECT doc_id, coalesce(left(t, list_filter(starts, lambda n: n > length(t) * 0.55)[1]), t) AS cut FROM p)
    SELECT doc_id, sha256(cut) AS whole_hash, greatest(length(cut) - 2000, 0) AS omitted, CASE WHEN length(cut) <= 2000 THEN sha256(cut)
      ELSE sha256(left(cut, 1360) || chr(10) || chr(10) || '[... middle of paper omitted for request size ...]' || chr(10) || chr(10) || right(cut, 640)) END AS compact_hash
    FROM c
    """
)
def compact_docs(spark, folder):
    full = F.concat(X.strip("text"), F.lit("\n\n References \n"), "source")
    docs = table(spark, folder, "documents").withColumn("full_text", full)
    return docs.select(
        "doc_id",
        F.sha2(X.compact_text("full_text"), 256).alias("whole_hash"),
        X.omitted_chars("full_text", 2000).cast("bigint").alias("omitted"),
        F.sha2(X.compact_text("full_text", 2000), 256).alias("compact_hash"),
    )


@query(
    rf"""
    WITH d AS (SELECT doc_id, {DOC_STRIPPED} AS t FROM documents),
    a AS (SELECT doc_id, t, list_filter(list_transform(string_split(regexp_replace(regexp_replace(t, '([.!?。])\s+', '\1' || chr(1), 'g'), ';\s+', chr(1), 'g'), chr(1)),
            lambda x: trim(x)), lambda x: x <> '') AS points,
          list_filter(list_transform(string_split(regexp_replace(t, ',\s+([A-Za-z가-힣])', chr(1) || '\1', 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '') AS clauses
          FROM d)
    SELECT doc_id, array_to_string(CASE WHEN len(points) <= 1 AND length(t) > 90 THEN clauses ELSE points END, '|') AS points
    FROM a
    """
)
def sentence_points(spark, folder):
    return table(spark, folder, "documents").select("doc_id", F.array_join(S.sentence_points("text"), "|").alias("points"))


@query(
    rf"""
    WITH d AS (SELECT conv_id, turn, '- ' || {DOC_STRIPPED} AS t FROM conversations),
    a AS (SELECT conv_id, turn, t,
          list_filter(list_transform(string_split(regexp_replace(regexp_replace(regexp_replace(t, '([.!?。])\s+', '\1' || chr(1), 'g'), ';\s+', chr(1), 'g'), '\n+', chr(1), 'g'), chr(1)),
            lambda x: trim(x, ' •-' || chr(9))), lambda x: x <> '') AS points,
          list_filter(list_transform(string_split(regexp_replace(t, ',\s+([A-Za-z가-힣])', chr(1) || '\1', 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '') AS clauses
          FROM d)
    SELECT conv_id, turn, array_to_string(CASE WHEN len(points) <= 1 AND length(t) > 100 THEN clauses ELSE points END, '|') AS points
    FROM a
    """
)
def split_points(spark, folder):
    text = F.concat(F.lit("- "), X.strip("text"))
    points = F.array_join(S.split_points(text), "|")
    return table(spark, folder, "conversations").select("conv_id", "turn", points.alias("points"))


def _chunk_sql(limit: int) -> str:
    return rf"""
    WITH s AS (
      SELECT doc_id, list_filter(string_split(regexp_replace({DOC_SQUEEZED}, '([.!?]) +', '\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') AS sents
      FROM documents),
    f AS (
      SELECT doc_id, list_reduce(list_transform(sents, lambda q: {{'done': CAST([] AS VARCHAR[]), 'cur': q}}),
        lambda a, x: CASE
          WHEN length(a.cur) + length(x.cur) + 1 <= {limit} THEN
            {{'done': a.done, 'cur': CASE WHEN a.cur = '' THEN x.cur ELSE a.cur || ' ' || x.cur END}}
          ELSE {{'done': list_concat(CASE WHEN a.cur = '' THEN a.done ELSE list_append(a.done, a.cur) END,
                   CASE WHEN length(x.cur) <= {limit} THEN CAST([] AS VARCHAR[])
                        ELSE list_transform(range(0, length(x.cur) // {limit}), lambda i: substr(x.cur, i * {limit} + 1, {limit})) END),
                'cur': CASE WHEN length(x.cur) <= {limit} THEN x.cur ELSE substr(x.cur, (length(x.cur) // {limit}) * {limit} + 1, {limit}) END}}
        END, {{'done': CAST([] AS VARCHAR[]), 'cur': ''}}) AS acc
      FROM s),
    c AS (SELECT doc_id, CASE WHEN acc.cur = '' THEN acc.done ELSE list_append(acc.done, acc.cur) END AS chunks FROM f)
    SELECT doc_id, CAST(len(chunks) AS BIGINT) AS n_chunks, sha256(array_to_string(chunks, '|')) AS chunk_hash FROM c
    """


def _chunked(spark, folder, limit):
    docs = table(spark, folder, "documents").select("doc_id", S.chunk_text("text", limit).alias("chunks"))
    return docs.select(
        "doc_id",
        F.size("chunks").cast("bigint").alias("n_chunks"),
        F.sha2(F.array_join("chunks", "|"), 256).alias("chunk_hash"),
    )


@query(_chunk_sql(S.CHUNK_CHARS))
def chunk_docs(spark, folder):
    return _chunked(spark, folder, S.CHUNK_CHARS)


@query(_chunk_sql(S.FALLBACK_CHUNK_CHARS))
def chunk_docs_fallback(spark, folder):
    return _chunked(spark, folder, S.FALLBACK_CHUNK_CHARS)


@query(
    """
    WITH p AS (
      SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(text), 'mit license', chr(1), 'g'), 'de la', chr(1), 'g'), 'tion', chr(1), 'g'), 'the', chr(1), 'g') AS t
      FROM documents)
    SELECT doc_id, TRUE AS same_text, sha256(t) AS protected_hash, length(t) - length(replace(t, chr(1), '')) AS n_terms FROM p
    """
)
def protect_roundtrip(spark, folder):
    """Protected and restored text equals the original; the protected lower-case text, which holds no symbols of its own, as SQL states it."""
    protect = protect_terms_text(["the", "MIT License", "tion", "de la"])
    docs = table(spark, folder, "documents").select("doc_id", "text", protect("text").alias("p"), protect(F.lower("text")).alias("q"))
    return docs.select(
        "doc_id",
        (restore_text("p.text", "p.terms") == F.col("text")).alias("same_text"),
        F.sha2(F.regexp_replace("q.text", "\ue000[\ue010-\ue019]+\ue001", "\x01"), 256).alias("protected_hash"),
        F.size("q.terms").cast("bigint").alias("n_terms"),
    )


_UPPER = "'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ'"
_MARKS = "".join(chr(0xE010 + d) for d in range(10))


@query(
    rf"""
    WITH x AS (SELECT doc_id, lang, lower(text) AS text FROM documents),
    g AS (SELECT doc_id, array_to_string(list_transform(string_split(text, 'the'), lambda p, i: CASE WHEN i = 1 THEN p
            ELSE chr(57344) || translate(CAST(i - 2 AS VARCHAR), '0123456789', '{_MARKS}') || chr(57345) || p END), '') AS t FROM x WHERE lang = 'en' AND text <> ''),
    """
    + _chunk_sql(S.FALLBACK_CHUNK_CHARS).replace("WITH s AS", "s AS").replace("FROM documents", "FROM g").replace("regexp_replace(text,", "regexp_replace(t,").split("SELECT doc_id, CAST(len(chunks)")[0]
    + rf""",
    p AS (SELECT doc_id, unnest(range(len(chunks))) AS pos, unnest(chunks) AS chunk FROM c),
    a AS (SELECT doc_id, pos, substr(sha256(chunk), 1, 1) IN ('0', '1') AS kept, CASE WHEN substr(sha256(chunk), 1, 1) IN ('0', '1') THEN chunk ELSE translate(chunk, {_UPPER}) END AS v FROM p),
    j AS (SELECT doc_id, string_agg(v, ' ' ORDER BY pos) AS v, count(*) AS n_chunks, count(*) FILTER (kept) AS n_kept FROM a GROUP BY doc_id)
    SELECT x.doc_id, sha256(coalesce(regexp_replace(v, chr(57344) || '[\s{_MARKS}]+' || chr(57345), 'the', 'g'), text)) AS rewritten_hash,
      coalesce(n_chunks, 0) AS n_chunks, coalesce(n_kept, 0) AS n_kept FROM x LEFT JOIN j USING (doc_id)
    """
)
def protect_docs(spark, folder):
    """English texts through a rewriter that writes capitals, answers some chunks with an error page and loses others; ``the`` is protected, other languages stay."""
    texts = table(spark, folder, "documents").select("doc_id", "lang", F.lower("text").alias("text"))
    terms = spark.createDataFrame([("the",), ("no such term",)], "term string")
    plan = rewriting.plan_rewriting(texts, terms, wanted=F.col("lang") == "en", max_chars=S.FALLBACK_CHUNK_CHARS)
    capitals = F.translate("chunk", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
    answer = F.when(F.col("chunk_id").startswith("0"), "<html>Error 500 (Server Error)</html>").otherwise(capitals)
    answers = rewriting.chunk_requests(plan).where(~F.col("chunk_id").startswith("1")).select("chunk_id", answer.alias("answer"))
    return rewriting.apply_answers(plan, answers).select("doc_id", F.sha2("rewritten", 256).alias("rewritten_hash"), "n_chunks", "n_kept")


@query(
    """
    WITH c AS (SELECT doc_id, text, len(regexp_extract_all(text, '[À-ÿ]')) AS a, len(regexp_extract_all(text, '[A-Za-zÀ-ÿ]')) AS n FROM documents)
    SELECT doc_id, round(a / nullif(n, 0), 6) AS ratio,
           CASE WHEN text = '' THEN TRUE ELSE coalesce(a / nullif(n, 0) > 0.05, FALSE) END AS mostly_accented,
           CASE WHEN text = '' THEN TRUE ELSE FALSE END AS mostly_korean
    FROM c
    """
)
def script_ratio(spark, folder):
    return table(spark, folder, "documents").select(
        "doc_id",
        F.round(X.script_ratio("text", "[À-ÿ]", "[A-Za-zÀ-ÿ]"), 6).alias("ratio"),
        X.mostly_script("text", "[À-ÿ]", "[A-Za-zÀ-ÿ]", 0.05).alias("mostly_accented"),
        X.mostly_korean("text").alias("mostly_korean"),
    )


@query(
    """
    SELECT page_id,
      html = '' OR contains(lower(html), '<html') OR contains(lower(html), '<!doctype html') OR contains(lower(html), 'error 500') AS html_is_error,
      url = '' OR contains(lower(url), 'blog') OR contains(lower(url), '#top') AS url_is_marked
    FROM pages
    """
)
def marker_filter(spark, folder):
    return table(spark, folder, "pages").select(
        "page_id",
        X.is_error_page("html").alias("html_is_error"),
        X.is_error_page("url", ("blog", "#top")).alias("url_is_marked"),
    )


@query(
    rf"""
    WITH s AS (SELECT doc_id, {DOC_STRIPPED} AS t FROM documents),
    c AS (
      SELECT doc_id, t, len(regexp_extract_all(t, '\S+')) AS words, len(regexp_extract_all(t, '[.,;:]')) AS punct,
        len(regexp_extract_all(regexp_replace(t, '[À-ÖØ-öø-ÿ]', '0', 'g'), '\b[A-Za-z][A-Za-z-]{{2,}}\b')) AS alpha
      FROM s)
    SELECT doc_id, words >= 20 AND alpha >= 10 AND alpha / greatest(words, 1) >= 0.35 AND punct >= 2 AS prose,
      length(t) >= 120 AND words >= 22 AND punct >= 2 AS body_prose, words >= 20 AND punct >= 2 AS loose_prose,
      CAST(words AS BIGINT) AS n_words
    FROM c
    """
)
def prose_filter(spark, folder):
    return table(spark, folder, "documents").select(
        "doc_id",
        X.is_prose("text").alias("prose"),
        X.is_body_prose("text").alias("body_prose"),
        X.is_loose_prose("text").alias("loose_prose"),
        X.word_count("text").cast("bigint").alias("n_words"),
    )


def _panel_markers(spark, folder):
    first = F.char((F.lit(65) + F.col("p_partkey") % 8).cast("bigint"))
    second = F.char((F.lit(65) + F.col("p_size") % 10).cast("bigint"))
    sep = F.element_at(F.array(*[F.lit(s) for s in ("-", " to ", " and ", ", ")]), (F.col("p_size") % 4 + 1).cast("int"))
    return table(spark, folder, "part").select("p_partkey", F.concat(first, sep, second, F.lit(", K")).alias("raw"))


PANELS_SQL = """
    WITH c AS (SELECT p_partkey, CAST(65 + p_partkey % 8 AS INT) AS a, 65 + p_size % 10 AS b, p_size % 4 AS sep FROM part),
    l AS (
      SELECT p_partkey, list_append(CASE WHEN sep < 2 THEN range(a, b + 1) WHEN a = b THEN [a] ELSE [a, b] END, CAST(75 AS BIGINT)) AS codes FROM c)
"""


@query(
    PANELS_SQL
    + """
    SELECT p_partkey, array_to_string(list_transform(codes, lambda x: chr(CAST(x AS INT))), '') AS labels,
      CASE WHEN len(codes) >= 2 AND codes = range(codes[1], codes[-1] + 1) THEN chr(CAST(codes[1] AS INT)) || '-' || chr(CAST(codes[-1] AS INT))
           ELSE array_to_string(list_transform(codes, lambda x: chr(CAST(x AS INT))), ',') END AS compact
    FROM l
    """
)
def expand_panels(spark, folder):
    rows = _panel_markers(spark, folder).withColumn("l", L.expand_panel_labels("raw"))
    return rows.select("p_partkey", F.array_join("l", "").alias("labels"), L.compact_panel_range("l").alias("compact"))


@query(
    """
    WITH c AS (SELECT p_partkey, 65 + p_size % 8 AS a, 65 + CAST(p_partkey % 8 AS INT) AS b FROM part)
    SELECT p_partkey, CASE WHEN b - a >= 1 THEN chr(a) || '-' || chr(b) WHEN a = b THEN chr(a) ELSE '' END AS compact FROM c
    """
)
def compact_panels(spark, folder):
    a, b = F.lit(65) + F.col("p_size") % 8, F.lit(65) + F.col("p_partkey") % 8
    codes = F.when(a <= b, F.sequence(a.cast("bigint"), b.cast("bigint"))).otherwise(F.array().cast("array<bigint>"))
    labels = F.concat(F.transform(codes, F.char), F.array(F.lit("AA"), F.lit("")))
    return table(spark, folder, "part").select("p_partkey", L.compact_panel_range(labels).alias("compact"))


@query(
    """
    WITH d AS (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem),
    g AS (SELECT l_orderkey, list('Fig. ' || l_linenumber ORDER BY l_linenumber) AS labels FROM d GROUP BY l_orderkey)
    SELECT o_orderkey, CASE WHEN labels IS NULL THEN 'No linked Figures' WHEN len(labels) <= 5 THEN array_to_string(labels, ', ')
      ELSE array_to_string(labels[1:5], ', ') || ' +' || (len(labels) - 5) || ' more' END AS preview
    FROM orders LEFT JOIN g ON l_orderkey = o_orderkey
    """
)
def label_preview(spark, folder):
    # line numbers are few, so the list of distinct ones is small however many rows an order has
    lines = table(spark, folder, "lineitem").groupBy("l_orderkey").agg(
        F.transform(
            F.array_sort(F.collect_set("l_linenumber")), lambda n: F.concat(F.lit("Fig. "), n.cast("string"))
        ).alias("labels")
    )
    orders = table(spark, folder, "orders").select("o_orderkey")
    joined = orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return joined.select("o_orderkey", L.label_preview("labels").alias("preview"))


def _facet_values_sql() -> str:
    rows = [(f, v, names[1]) for f, vs in FACET_VALUES.items() for v, names in vs.items()]
    return ", ".join("('{}', '{}', '{}')".format(*[x.replace("'", "''") for x in r]) for r in rows)


@query(
    f"""
    WITH labels(facet, value, label) AS (VALUES {_facet_values_sql()}),
    p AS (SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'material' ELSE 'output' END AS facet,
            CASE p_type WHEN 'STANDARD' THEN 'dna' WHEN 'MEDIUM' THEN 'abundance' WHEN 'PROMO' THEN 'chromatin' WHEN 'SMALL' THEN 'morphology'
              ELSE lower(p_type) END AS value FROM part)
    SELECT p_partkey, coalesce(label, p.value) AS label FROM p LEFT JOIN labels ON labels.facet = p.facet AND labels.value = p.value
    """
)
def facet_labels(spark, folder):
    known = {"STANDARD": "dna", "MEDIUM": "abundance", "PROMO": "chromatin", "SMALL": "morphology"}
    names = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    value = F.coalesce(F.try_element_at(names, F.col("p_type")), F.lower("p_type"))
    facet = F.when(F.col("p_size") % 2 == 0, "material").otherwise("output")
    return table(spark, folder, "part").select("p_partkey", facet_label(facet, value).alias("label"))


@query(
    r"""
    SELECT doc_id, sha256(text) AS file_hash,
      left(sha256(trim(regexp_replace(replace(lower(text), 'ß', 'ss'), '[^a-z0-9]+', ' ', 'g'))), 24) AS title_digest,
      left(sha256(trim(regexp_replace(replace(lower(text), 'ß', 'ss'), '\s+', ' ', 'g'))), 16) AS legend_digest
    FROM documents
    """
)
def content_hash(spark, folder):
    return table(spark, folder, "documents").select(
        "doc_id",
        X.content_hash("text").alias("file_hash"),
        X.title_digest("text").alias("title_digest"),
        X.legend_digest("text").alias("legend_digest"),
    )


@query(
    r"""
    SELECT p_partkey, 'single_figure:' || p_type || '_' || regexp_replace(p_brand, '#', '_') || ':legend_' || left(sha256(p_name || ' ' || lower(p_type)), 16) AS stage_key
    FROM part
    """
)
def figure_stage_key(spark, folder):
    label = F.concat("p_type", F.lit(" / "), "p_brand", F.lit("!"))
    legend = F.concat(F.lit(" "), F.upper("p_name"), F.lit(" \n "), "p_type", F.lit(" "))
    return table(spark, folder, "part").select("p_partkey", X.figure_stage_key(label, legend).alias("stage_key"))


@query(
    r"""
    WITH k AS (SELECT event_id, CAST(regexp_extract(props, '"k": (\d+)', 1) AS BIGINT) AS k FROM events)
    SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 1000 + k WHEN event_id % 3 = 1 THEN k ELSE -1 END AS parsed,
      CASE WHEN event_id % 3 = 2 THEN 25 ELSE greatest(10, least(50, k)) END AS bounded
    FROM k
    """
)
def safe_int(spark, folder):
    k, kind = F.get_json_object("props", "$.k"), F.col("event_id") % 3
    number = F.when(kind == 0, F.concat(F.lit(" 1,"), F.lpad(k, 3, "0"))).when(kind == 1, k).otherwise("n/a")
    clamp = F.when(kind < 2, k).otherwise("n/a")
    return table(spark, folder, "events").select(
        "event_id", X.safe_int(number, -1).alias("parsed"), X.bounded_int(clamp, 25, 10, 50).alias("bounded")
    )


@query(
    r"""
    WITH l AS (
      SELECT doc_id, unnest(list_transform(string_split(text, chr(10)), lambda x: trim(x))) AS line,
             generate_subscripts(string_split(text, chr(10)), 1) AS pos
      FROM documents),
    k AS (SELECT * FROM l WHERE length(line) >= 2 AND NOT starts_with(line, 'http://') AND NOT starts_with(line, 'https://')),
    c AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) AS body FROM k GROUP BY doc_id)
    SELECT doc_id, sha256(coalesce(body, '')) AS text_hash FROM documents LEFT JOIN c USING (doc_id)
    """
)
def collect_text(spark, folder):
    lines = F.split("text", "\n")
    return table(spark, folder, "documents").select("doc_id", F.sha2(S.collect_text(lines), 256).alias("text_hash"))


@query(
    """
    WITH u AS (
      SELECT conv_id, turn, text, coalesce(sum(length(text) + 1) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used
      FROM conversations)
    SELECT conv_id, turn, CAST(b AS BIGINT) AS bundle,
      substr(text, CAST(greatest(b * 1000 - used, 0) AS BIGINT) + 1, CAST(least((b + 1) * 1000 - used, length(text)) - greatest(b * 1000 - used, 0) AS BIGINT)) AS text
    FROM u, LATERAL (SELECT unnest(range(CAST(used AS BIGINT) // 1000, CAST(greatest(used + length(text) - 1, used) AS BIGINT) // 1000 + 1)) AS b)
    """
)
def running_cut(spark, folder):
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "text")
    return bundle_by_length(turns, ["conv_id"], ["turn"], F.floor(F.col("turn") / 4), "text", 1000)


@query("SELECT doc_id AS paper_key, source AS provider, lang AS language, n_chars AS size_chars FROM documents")
def project_columns(spark, folder):
    columns = {"paper_key": "doc_id", "provider": "source", "language": "lang", "size_chars": "n_chars"}
    return keyed.project(table(spark, folder, "documents"), columns)


@query(
    """
    WITH d AS (SELECT doc_id, source || ' ' || lang AS title, string_split(text, chr(10)) AS lines FROM documents),
    m AS (SELECT doc_id, title, list_filter(lines, lambda x: contains(replace(lower(x), 'ß', 'ss'), 'rc1')) AS a,
            list_filter(lines, lambda x: contains(replace(lower(x), 'ß', 'ss'), 'sted')) AS b FROM d)
    SELECT doc_id, CAST(len(b) AS BIGINT) AS n_matching, sha256(array_to_string(b, '|')) AS match_hash
    FROM m WHERE contains(lower(title), 'sted') OR len(b) > 0
    """
)
def scoped_search(spark, folder):
    lines = F.transform(
        F.split("text", "\n"), lambda t, i: F.struct(F.concat(F.lit("Fig. "), i.cast("string")).alias("figure"), t.alias("caption"))
    )
    papers = table(spark, folder, "documents").select(
        "doc_id", F.concat_ws(" ", "source", "lang").alias("title"), lines.alias("figures")
    )
    found = search.scoped_search(papers, "STED", scope="both", figures_only=True)
    return found.select(
        "doc_id",
        F.size("matching_figures").cast("bigint").alias("n_matching"),
        F.sha2(F.array_join("matching_figures.caption", "|"), 256).alias("match_hash"),
    )


@query(
    """
    SELECT event_id, event_type IN ('click', 'view', 'purchase') AND value >= 10 AND value IS NOT NULL AND k < 90 AS valid,
      concat_ws(',', CASE WHEN event_type NOT IN ('click', 'view', 'purchase') THEN 'type' END, CASE WHEN NOT (value >= 10) THEN 'value' END,
                CASE WHEN NOT (k < 90) THEN 'k' END) AS errors
    FROM (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k FROM events)
    """
)
def validate_records(spark, folder):
    parsed = table(spark, folder, "events").withColumn("p", F.from_json("props", "k int"))
    rules = {
        "type": F.col("event_type").isin("click", "view", "purchase"),
        "value": F.col("value") >= 10,
        "k": F.col("p.k") < 90,
    }
    checked = records.validate(parsed, rules)
    return checked.select("event_id", "valid", F.array_join("errors", ",").alias("errors"))


def _entry_columns(lang):
    name, size = F.col("p_name"), F.col("p_size")
    none = F.lit(None).cast("array<string>")
    return {
        f"summary_{lang}": F.when(size % 3 == 0, " ").otherwise(F.concat(name, F.lit(". "), "p_type")),
        f"principle_{lang}": F.when(size % 2 == 0, F.concat(F.lit("First "), name, F.lit(".\nThen "), "p_type", F.lit("; end"))).otherwise(""),
        f"best_for_{lang}": F.when(size % 5 == 0, F.col("p_brand")),
        f"limitations_{lang}": F.when(size % 7 == 0, F.concat("p_type", F.lit("\n- "), "p_brand")),
        f"key_question_{lang}": F.when(size % 4 == 0, F.concat(F.lit("Why "), name, F.lit("?"))),
        f"one_liner_{lang}": F.when(size % 6 == 0, name),
        f"principle_steps_{lang}": F.when(size % 8 == 0, F.array(name, F.col("p_type"))).otherwise(none),
        f"best_for_points_{lang}": none,
        f"limitation_points_{lang}": none,
        f"interpretation_tip_{lang}": F.lit(""),
    }


@query(
    """
    WITH e AS (
      SELECT p_partkey, p_name, p_type, p_brand, p_size, trim(CASE WHEN p_size % 3 = 0 THEN ' ' ELSE p_name || '. ' || p_type END) AS summary FROM part)
    SELECT p_partkey,
      CASE WHEN p_size % 4 = 0 THEN 'Why ' || p_name || '?' ELSE 'What biological question does ' || p_name || ' answer?' END AS key_question,
      CASE WHEN p_size % 6 = 0 THEN p_name ELSE summary END AS one_liner,
      CASE WHEN p_size % 8 = 0 THEN p_name || '|' || p_type WHEN p_size % 2 = 0 THEN 'First ' || p_name || '.|Then ' || p_type || '|end'
           WHEN summary <> '' THEN summary ELSE p_name END AS steps,
      CASE WHEN p_size % 5 = 0 THEN p_brand ELSE 'Use it for questions the assay can directly address.' END AS best_for,
      CASE WHEN p_size % 7 = 0 THEN p_type || '|' || p_brand ELSE 'Do not equate a measured association with biological causality.' END AS limitations,
      'Distinguish the assay''s direct measurement from the biological interpretation inferred from it.' AS tip
    FROM e
    """
)
def repair_records(spark, folder):
    entries = table(spark, folder, "part").withColumn("canonical_name", F.col("p_name")).withColumns(_entry_columns("en"))
    fixed = records.repair_method_entries(entries, langs=("en",))
    return fixed.select(
        "p_partkey",
        F.col("key_question_en").alias("key_question"),
        F.col("one_liner_en").alias("one_liner"),
        F.array_join("principle_steps_en", "|").alias("steps"),
        F.array_join("best_for_points_en", "|").alias("best_for"),
        F.array_join("limitation_points_en", "|").alias("limitations"),
        F.col("interpretation_tip_en").alias("tip"),
    )


@query(
    """
    SELECT p_partkey, 'What biological question does ' || p_name || ' answer?' AS key_question,
      CASE WHEN p_size % 3 = 0 THEN p_name || '|' || p_type ELSE p_type || '.|' || p_brand END AS steps
    FROM part
    """
)
def method_articles(spark, folder):
    """Reading view in one language from stored columns; stored points come back as points."""
    stored = records.stored_points(
        F.when(F.col("p_size") % 3 == 0, F.array("p_name", F.lit(" "), "p_type")), F.concat("p_type", F.lit(". "), "p_brand")
    )
    entries = table(spark, folder, "part").select(
        "p_partkey",
        F.col("p_name").alias("canonical_name"),
        F.col("p_type").alias("summary_en"),
        stored.alias("principle_en"),
        F.lit("").alias("best_for_en"),
        F.lit("").alias("limitations_en"),
    )
    return records.method_article(entries, "en", carried=["p_partkey"]).select(
        "p_partkey", "key_question", F.array_join("principle_steps", "|").alias("steps")
    )


@query()
def annotate_docs(spark, folder):
    """First mention of each glossary term per document annotated; the lines of a document are one bundle."""
    glossary = [("the", "참조"), ("MIT License", "MIT 라이선스"), ("License", "라이선스"), ("der", "정관사")]
    docs = seed_glossary(table(spark, folder, "documents").select("doc_id", "text"), "text", glossary)
    lines = annotate_texts(F.split("text", "\n"), F.col("glossary"))
    return docs.select(
        "doc_id", F.size("glossary").alias("n_terms"), F.sha2(F.array_join(lines, "\n"), 256).alias("annotated_hash")
    )
