"""Queries of the operators of this subpackage over the given tables, with SQL where SQL can state the result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuskit.llm import (
    ann_forest,
    block_search,
    brown_lm,
    collocations,
    html_extract,
    labelled_pages,
    mixing,
    packing,
    quality_rules,
    simhash_dedup,
    spelling_groups,
    token_files,
    toxicity,
    url_filter,
)
from corpuskit.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


URL_RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)


@query
def op1_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    rules = spark.createDataFrame(list(URL_RULES), "action string, host string, path string")
    pages = table(spark, folder, "pages").select("page_id", "url")
    return url_filter.judge_urls(pages, rules).select("page_id", "host", "path", "rule", "verdict")


ORACLES["op1_url_filter"] = """
WITH rules(action, host, path) AS (VALUES {rules}),
urls AS (
  SELECT page_id, coalesce(strpos(url, '://'), 0) AS p, substr(url, strpos(url, '://') + 3) AS rest FROM pages
), cut AS (
  SELECT page_id, row_number() OVER () AS n,
    CASE WHEN p > 0 THEN translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
    CASE WHEN p > 0 THEN regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path
  FROM urls
), met AS (
  SELECT c.n, r.host || r.path AS rule, r.action,
    row_number() OVER (PARTITION BY c.n ORDER BY length(r.host || r.path) DESC, length(r.host) DESC, r.action DESC) AS k
  FROM cut c JOIN rules r ON (c.host = r.host OR ends_with(c.host, '.' || r.host)) AND starts_with(c.path, r.path)
)
SELECT c.page_id, c.host, c.path, m.rule, coalesce(m.action, 'allow') AS verdict
FROM cut c LEFT JOIN met m ON c.n = m.n AND m.k = 1
""".format(rules=", ".join(str(r) for r in URL_RULES))


@query
def op2_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality_rules.quality_table(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query
def op4_simhash_dedup(spark: SparkSession, folder: str) -> DataFrame:
    groups = simhash_dedup.group_documents(table(spark, folder, "documents"), width=4, radius=4, similar=None)
    return groups.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@query
def op6_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"))


@query
def op7_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.score_documents(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query
def op8_source_mixing(spark: SparkSession, folder: str) -> DataFrame:
    mixed, p = mixing.mix(table(spark, folder, "documents").select("doc_id", "text", "source"))
    return mixed.select("doc_id", *[F.col(f"{p}{c}").alias(c) for c in ("size", "source_size", "target", "copies", "taken")])


ORACLES["op8_source_mixing"] = r"""
WITH sized AS (
  SELECT doc_id, source, md5(coalesce(doc_id::VARCHAR, '')) AS h,
    len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')) AS size
  FROM documents
), docs AS (
  SELECT *, CASE WHEN size < 256 THEN size ELSE length(bin(size)) * 128 + (size >> (length(bin(size)) - 7)::INT) END AS class FROM sized
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS no FROM docs GROUP BY source
), limits AS (
  SELECT *, CASE no % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight, 3.0::DOUBLE * source_size AS most FROM sources
), shares AS (
  SELECT *,
    (sum(source_size) OVER ())::DOUBLE - coalesce(sum(most) OVER (ORDER BY most / weight, no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS remaining,
    sum(weight) OVER (ORDER BY most / weight, no ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weights
  FROM limits
), levels AS (
  SELECT *, max(CASE WHEN most / weight >= remaining / weights THEN remaining / weights END) OVER () AS level FROM shares
), targets AS (
  SELECT source, source_size, CASE WHEN most <= weight * level THEN most ELSE weight * level END AS target FROM levels
), placed AS (
  SELECT d.doc_id, d.source, d.size, t.source_size, t.target,
    CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 1.0 END AS rate,
    row_number() OVER (PARTITION BY d.source ORDER BY d.class, ('0x' || substr(d.h, 1, 2))::INT, d.h, d.size) AS place
  FROM docs d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source
), draws AS (
  SELECT source, k, (('0x' || substr(md5('mix' || coalesce(source, '')), 1, 3))::INT::DOUBLE / 4096 + k::DOUBLE / 32) % 1.0::DOUBLE AS offs FROM targets, range(32) r(k)
), tried AS (
  SELECT p.source, d.k, d.offs, abs(sum((floor(p.place * p.rate + d.offs) - floor((p.place - 1) * p.rate + d.offs))::BIGINT * p.size)::DOUBLE - first(p.target)) AS off
  FROM placed p JOIN draws d ON p.source IS NOT DISTINCT FROM d.source GROUP BY p.source, d.k, d.offs
), chosen AS (
  SELECT source, offs FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY off, k) AS n FROM tried) WHERE n = 1
), taken AS (
  SELECT p.*, (floor(place * rate + offs) - floor((place - 1) * rate + offs))::BIGINT AS copies
  FROM placed p JOIN chosen c ON p.source IS NOT DISTINCT FROM c.source
)
SELECT doc_id, size::BIGINT AS size, source_size, target, copies, copies * size AS taken FROM taken
"""


TOKENIZER = "word_bpe_49k.json"


@query
def op5_token_files(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    written = token_files.write_tokens(table(spark, folder, "documents"), public_tokenizers.path(TOKENIZER))
    return token_files.read_tokens(spark, written)


@query
def op3_nearest_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return ann_forest.nearest(table(spark, folder, "embeddings"))


@query
def op10_brown_language_model(spark: SparkSession, folder: str) -> DataFrame:
    return brown_lm.score_documents(table(spark, folder, "documents"))


@query
def op9_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    labelled = spark.createDataFrame([(p,) for p in labelled_pages.PAGES], "html string")
    return html_extract.extract_pages(table(spark, folder, "pages"), html_extract.fit(labelled))


@query
def op11_spelling_groups(spark: SparkSession, folder: str) -> DataFrame:
    return spelling_groups.group_spellings(table(spark, folder, "documents"))


# crc32 by its table of 256 entries, which the SQL derives from the polynomial
ORACLES["op11_spelling_groups"] = r"""
WITH RECURSIVE t AS MATERIALIZED (
  SELECT list_transform(range(256), lambda b: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b)) AS tab
), runs AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{C0}-\x{FF}]+')) AS run FROM documents
), found AS (
  SELECT doc_id, run, count(*) AS n, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS x FROM runs WHERE length(run) >= 7 GROUP BY doc_id, run
), hashed AS (
  SELECT run, n, xor(list_reduce(list_transform(range(0, length(x), 2), lambda i: ('0x' || substr(x, i + 1, 2))::BIGINT), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1]), 4294967295::BIGINT), 4294967295::BIGINT) AS h
  FROM found, t
), cut AS (
  SELECT CASE WHEN h % 31 = 0 THEN left(run, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, n FROM hashed
), words AS MATERIALIZED (
  SELECT word, sum(n)::BIGINT AS n FROM cut WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2
), less AS MATERIALIZED (
  SELECT word, i, left(word, i) || substr(word, i + 2) AS rest FROM (SELECT word, unnest(range(length(word)))::INT AS i FROM words)
), near AS MATERIALIZED (
  SELECT a.word, b.word AS other FROM less a JOIN less b ON a.i = b.i AND a.rest = b.rest AND length(a.word) = length(b.word) AND a.word <> b.word
  UNION SELECT l.word, w.word FROM less l JOIN words w ON w.word = l.rest UNION SELECT w.word, l.word FROM less l JOIN words w ON w.word = l.rest
), best AS MATERIALIZED (
  SELECT word, other, m, k FROM (SELECT near.word, other, o.n AS m, count(*) OVER (PARTITION BY near.word) AS k, row_number() OVER (PARTITION BY near.word ORDER BY o.n DESC, other) AS place
    FROM near JOIN words o ON o.word = near.other) WHERE place = 1
), formed AS MATERIALIZED (
  SELECT w.word, w.n, coalesce(k, 0) AS n_near, CASE WHEN m >= 10 * w.n THEN other END AS form, CASE WHEN m >= 10 * w.n THEN m END AS form_n FROM words w LEFT JOIN best USING (word)
), chain(word, root, d) AS (
  SELECT word, word, 0 FROM formed UNION ALL SELECT c.word, f.form, d + 1 FROM chain c JOIN formed f ON f.word = c.root WHERE f.form IS NOT NULL
)
SELECT f.word, form, c.root, n, n_near, form_n FROM formed f JOIN (SELECT word, arg_max(root, d) AS root FROM chain GROUP BY word) c USING (word)
"""


@query
def op12_exact_top_k(spark: SparkSession, folder: str) -> DataFrame:
    return block_search.top_scores(table(spark, folder, "embeddings"))


ORACLES["op12_exact_top_k"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score FROM v q, v c WHERE q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s QUALIFY rank <= 5
"""


@query
def op13_phrase_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocations.collocations(table(spark, folder, "documents"))


ORACLES["op13_phrase_collocations"] = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
    unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), split AS (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda w: w <> '') AS w FROM pieces
), placed AS (
  SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM split
), f AS (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS a FROM placed, range(1, 4) r(k) WHERE i + k - 1 <= len(w) GROUP BY ALL
), n AS (
  SELECT lang, sum(a)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang
), c AS (
  SELECT *, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND a >= 10
), held AS (
  SELECT lang, phrase, max(a) AS longer FROM (
    SELECT lang, array_to_string(w[1:2], ' ') AS phrase, a FROM c WHERE k = 3 UNION ALL SELECT lang, array_to_string(w[2:3], ' '), a FROM c WHERE k = 3
  ) GROUP BY ALL
), kept AS (
  SELECT c.* FROM c LEFT JOIN held h ON c.k = 2 AND c.lang = h.lang AND c.phrase = h.phrase WHERE h.longer IS NULL OR 100 * h.longer < 50 * c.a
), cuts AS (
  SELECT c.lang, c.phrase, c.a, s.cut, x.a AS l, y.a AS r, (1000000::HUGEINT * c.a * c.a) // (x.a::HUGEINT * y.a) AS score
  FROM kept c JOIN range(1, 3) s(cut) ON s.cut < c.k
  JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:s.cut], ' ')
  JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[s.cut + 1:], ' ')
), worst AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score::BIGINT AS score
FROM worst JOIN n USING (lang) QUALIFY rank <= 2000
"""
