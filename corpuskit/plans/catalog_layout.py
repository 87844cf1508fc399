"""Catalogue: ordered joins, boxes and page layouts.

Page layouts are derived from the documents: the lines of a text become blocks on pages of eight slots, one slot per page carries a
caption, and images, drawings and appended figure pages are placed by rule.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuskit.operators import layout
from corpuskit.operators.ordered import last_known, pair_in_order
from corpuskit.plans.registry import ORACLES, query
from corpuskit.session import staged
from corpuskit.sources import layout as layout_source
from corpuskit.sources.tables import table


@query(
    """
    WITH p AS (SELECT user_id, event_id, ts, event_type,
        last_value(CASE WHEN event_type = 'error' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS error_id FROM events)
    SELECT user_id, event_id, error_id FROM p WHERE event_type = 'purchase'
    """
)
def asof_above(spark, folder):
    """Last error at or before each purchase of a user."""
    events = table(spark, folder, "events").select("user_id", "event_id", "ts", "event_type")
    errors = F.when(F.col("event_type") == "error", F.col("event_id"))
    known = last_known(events, ["user_id"], ["ts", "event_id"], F.to_date("ts"), errors, "error_id")
    return known.where("event_type = 'purchase'").select("user_id", "event_id", "error_id")


@query(
    """
    WITH o AS (SELECT l_orderkey, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS pair_no, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem WHERE l_linestatus = 'O'),
    f AS (SELECT l_orderkey, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS pair_no, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem WHERE l_linestatus = 'F')
    SELECT o.l_orderkey, o.l_partkey AS open_part, f.l_partkey AS final_part, o.pair_no FROM o JOIN f ON o.l_orderkey = f.l_orderkey AND o.pair_no = f.pair_no AND o.n = f.n
    """
)
def sequential_pairing(spark, folder):
    """Open and final lines of an order paired in line order, only where there are equally many."""
    lines = table(spark, folder, "lineitem")
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]

    def side(status, prefix):
        rows = lines.where(F.col("l_linestatus") == status)
        return rows.select("l_orderkey", *[F.col(c).alias(f"{prefix}_{c}") for c in order])

    def sorting(prefix):
        return [f"{prefix}_{c}" for c in order], F.floor(F.col(f"{prefix}_l_linenumber") / 1024)

    paired = pair_in_order(side("O", "o"), side("F", "f"), ["l_orderkey"], sorting("o"), sorting("f"))
    return paired.select(
        "l_orderkey", F.col("o_l_partkey").alias("open_part"), F.col("f_l_partkey").alias("final_part"), "pair_no"
    )


@query(
    """
    WITH b AS (SELECT l_orderkey, epoch(l_shipdate) / 86400 AS x0, epoch(l_shipdate) / 86400 + 30 AS x1, l_quantity AS y0, l_quantity + 10 AS y1, l_partkey FROM lineitem),
    r AS (SELECT o_orderkey, epoch(o_orderdate) / 86400 AS x0, epoch(o_orderdate) / 86400 + 1500 AS x1, 5.0 AS y0, 40.0 AS y1 FROM orders)
    SELECT o_orderkey, l_partkey, round((least(r.x1, b.x1) - greatest(r.x0, b.x0)) * (least(r.y1, b.y1) - greatest(r.y0, b.y0)), 4) AS overlap_area
    FROM r JOIN b ON o_orderkey = l_orderkey WHERE least(r.x1, b.x1) > greatest(r.x0, b.x0) AND least(r.y1, b.y1) > greatest(r.y0, b.y0)
    """
)
def overlap_join(spark, folder):
    """Ship windows of the lines that intersect the region of their order, with the shared area."""
    day = F.unix_date(F.to_date("l_shipdate")).cast("double")
    blocks = table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("key"), "l_partkey", day.alias("x0"), (day + 30).alias("x1"),
        F.col("l_quantity").alias("y0"), (F.col("l_quantity") + 10).alias("y1"),
    )
    start = F.unix_date(F.to_date("o_orderdate")).cast("double")
    regions = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("key"), start.alias("x0"), (start + 1500).alias("x1"), F.lit(5.0).alias("y0"), F.lit(40.0).alias("y1")
    )
    pairs = layout.overlap_pairs(regions, blocks, ["key"])
    return pairs.select(F.col("r.key").alias("o_orderkey"), "l_partkey", F.round("overlap_area", 4).alias("overlap_area"))


@query(
    """
    SELECT l_orderkey, min(l_quantity) AS x0, min(l_discount) AS y0, max(l_extendedprice) AS x1, max(l_tax) AS y1 FROM lineitem WHERE l_returnflag <> 'N' GROUP BY 1
    """
)
def union_bbox(spark, folder):
    boxes = table(spark, folder, "lineitem").select(
        "l_orderkey", F.when(F.col("l_returnflag") != "N", F.col("l_quantity")).alias("x0"), F.col("l_discount").alias("y0"),
        F.col("l_extendedprice").alias("x1"), F.col("l_tax").alias("y1"),
    )
    return layout.union_bbox(boxes, ["l_orderkey"])


@query(
    """
    SELECT l_orderkey, l_partkey, l_linenumber, CASE l_linenumber % 4 WHEN 0 THEN 'share' WHEN 1 THEN 'source' WHEN 2 THEN 'thousandth' END AS unit,
      round(CASE l_linenumber % 4 WHEN 0 THEN l_discount * 600 WHEN 1 THEN l_quantity / 100 * 600 WHEN 2 THEN l_quantity * 10 / 1000.0 * 600 END, 4) AS x0,
      round(CASE l_linenumber % 4 WHEN 0 THEN l_tax * 800 WHEN 1 THEN (l_quantity + 5) / 120 * 800 WHEN 2 THEN (l_quantity + 200) / 1000.0 * 800 END, 4) AS y1
    FROM lineitem
    """
)
def bbox_units(spark, folder):
    kind = F.col("l_linenumber") % 4
    q = F.col("l_quantity")

    def pick(share, source, thousandth, out_of_range):
        return F.when(kind == 0, share).when(kind == 1, source).when(kind == 2, thousandth).otherwise(out_of_range)

    boxes = table(spark, folder, "lineitem").select(
        "l_orderkey", "l_partkey", "l_linenumber",
        pick(F.col("l_discount"), q, q * 10, q).alias("x0"),
        pick(F.lit(0.0), q + 5, q, q).alias("y0"),
        pick(F.lit(1.0), q + 20, q * 10 + 300, F.lit(5000.0)).alias("x1"),
        pick(F.col("l_tax"), q + 5, q + 200, F.lit(6000.0)).alias("y1"),
        F.lit(600.0).alias("page_w"), F.lit(800.0).alias("page_h"), F.lit(100.0).alias("src_w"), F.lit(120.0).alias("src_h"),
    )
    boxes = boxes.withColumns({c: F.when(kind == 2, 0.0).otherwise(F.col(c)) for c in ("src_w", "src_h")})
    return layout.to_page_units(boxes).select(
        "l_orderkey", "l_partkey", "l_linenumber", "unit", F.round("x0", 4).alias("x0"), F.round("y1", 4).alias("y1")
    )


@query(
    """
    SELECT l_orderkey, l_partkey, l_linenumber, round(least(1.0, l_extendedprice / 50000) * 8 + least(3.5, l_linenumber * 0.75) + least(4.0, l_quantity * 0.12) + least(2.0, l_suppkey * 0.12)
      + least(1.2, least(1.0, l_quantity * 20 / 800) * 1.6) - least(4.5, l_linenumber * 1.15) - least(2.0, l_partkey / 900.0), 3) AS score
    FROM lineitem
    """
)
def evidence_score(spark, folder):
    """The scoring formula on numeric columns."""
    score = layout.evidence_score(
        F.col("l_extendedprice"), F.col("l_linenumber"), F.col("l_quantity"), F.col("l_suppkey"), F.col("l_linenumber"),
        F.col("l_partkey"), F.lit(50000.0), F.col("l_quantity") * 20, F.lit(800.0), digits=3,
    )
    return table(spark, folder, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", score.alias("score"))


# --- layouts derived from the documents ----------------------------------------------------------------------------

SLOTS = 8


def _layout(spark, folder, endmatter=True):
    docs = table(spark, folder, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), "text", "n_chars", "lang")
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    page, slot = F.floor(F.col("pos") / SLOTS).cast("int"), F.col("pos") % SLOTS
    caption = F.concat(F.lit("Figure "), page + 1, F.lit(". (A) "), "line")
    narrow = (slot == 5) & (page % 2 == 1)
    texts = lines.select(
        "doc_id", page.alias("page_idx"), F.col("pos").alias("block_id"), F.lit("text").alias("kind"),
        F.lit(40.0).alias("x0"), (F.lit(40.0) + slot * 90).cast("double").alias("y0"),
        F.when(narrow, 280.0).otherwise(560.0).alias("x1"), (F.lit(100.0) + slot * 90).cast("double").alias("y1"),
        F.when(slot == 5, caption).otherwise(F.col("line")).alias("text"), F.lit(600.0).alias("page_w"), F.lit(800.0).alias("page_h"),
    )
    n_pages = (F.floor((F.size(F.split("text", "\n")) - 1) / SLOTS) + 1).cast("int")
    placed = docs.select("doc_id", "n_chars", "lang", n_pages.alias("n_pages"))
    body = placed.select("doc_id", "n_chars", F.explode(F.sequence(F.lit(0), F.col("n_pages") - 1)).alias("page_idx"))
    width = F.col("n_chars") % 400

    def box(rows, block_id, kind, x0, y0, x1, y1, text=""):
        return rows.select(
            "doc_id", "page_idx", F.lit(block_id).alias("block_id"), F.lit(kind).alias("kind"), F.lit(x0).alias("x0"), F.lit(y0).alias("y0"),
            x1.cast("double").alias("x1"), F.lit(y1).alias("y1"), F.lit(text).alias("text"), F.lit(600.0).alias("page_w"), F.lit(800.0).alias("page_h"),
        )

    pages = (
        texts.unionByName(box(body, 2_000_000, "image", 60.0, 320.0, F.lit(60.0) + width, 420.0))
        .unionByName(box(body, 2_000_001, "drawing", 50.0, 300.0, F.lit(100.0) + width, 430.0))
    )
    if not endmatter:
        return pages
    tail = placed.where("lang = 'en'").select("doc_id", "n_chars", F.col("n_pages").alias("page_idx"))
    return (
        pages.unionByName(box(tail, 2_000_002, "image", 100.0, 100.0, F.lit(300.0) + width / 2, 500.0))
        .unionByName(box(tail, 2_000_003, "text", 100.0, 510.0, F.lit(180.0), 525.0, "Figure 1"))
    )


_LAYOUT_SQL = r"""
    WITH lines AS (SELECT CAST(doc_id AS VARCHAR) AS doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents),
    texts AS (SELECT doc_id, CAST(pos // 8 AS INT) AS page_idx, pos AS block_id, 40.0 AS x0, 40.0 + (pos % 8) * 90 AS y0,
        CASE WHEN pos % 8 = 5 AND (pos // 8) % 2 = 1 THEN 280.0 ELSE 560.0 END AS x1, 100.0 + (pos % 8) * 90 AS y1,
        CASE WHEN pos % 8 = 5 THEN 'Figure ' || (pos // 8 + 1) || '. (A) ' || line ELSE line END AS text FROM lines),
    st AS (SELECT *, regexp_replace(regexp_replace(text, '^\s+', ''), '\s+$', '') AS t FROM texts),
    bl AS (SELECT *, len(regexp_extract_all(t, '\S+')) AS words, len(regexp_extract_all(t, '[.,;:]')) AS punct,
        len(regexp_extract_all(regexp_replace(t, '[À-ÖØ-öø-ÿ]', '0', 'g'), '\b[A-Za-z][A-Za-z-]{2,}\b')) AS alpha, regexp_matches(t, '^Figure \d+\b') AS is_caption FROM st),
    pr AS (SELECT *, NOT is_caption AND words >= 20 AND alpha >= 10 AND alpha / greatest(words, 1) >= 0.35 AND punct >= 2 AS prose FROM bl)
"""
_DOC_PAGES_SQL = """
    , np AS (SELECT CAST(doc_id AS VARCHAR) AS doc_id, n_chars, lang, CAST((len(string_split(text, chr(10))) - 1) // 8 + 1 AS INT) AS n_pages FROM documents)
"""


@query(
    _LAYOUT_SQL
    + _DOC_PAGES_SQL
    + """
    , tail AS (SELECT doc_id, n_pages AS page_idx, 2000003 AS block_id, 'Figure 1' AS caption, 'fig1' AS figure_key FROM np WHERE lang = 'en'),
    c AS (SELECT doc_id, page_idx, block_id, t AS caption, 'fig' || CAST(regexp_extract(t, '^Figure ([0-9]+)', 1) AS INT) AS figure_key FROM pr WHERE is_caption UNION ALL SELECT * FROM tail)
    SELECT doc_id, figure_key, page_idx, sha256(caption) AS caption_hash, length(caption) + CASE WHEN contains(caption, '(A)') THEN 300 ELSE 0 END AS score
    FROM c QUALIFY row_number() OVER (PARTITION BY doc_id, figure_key ORDER BY score DESC, page_idx, block_id) = 1
    """
)
def caption_blocks(spark, folder):
    """Best caption block per figure of every derived layout."""
    best = layout.best_captions(_layout(spark, folder))
    return best.select("doc_id", "figure_key", "page_idx", F.sha2("caption", 256).alias("caption_hash"), F.col("score").cast("bigint").alias("score"))


_REGION_SQL = (
    _LAYOUT_SQL
    + """
    , c AS (SELECT doc_id, page_idx, 'fig' || (page_idx + 1) AS figure_key, x0, y0, x1,
        CASE WHEN (x1 - x0) / 600 >= 0.68 THEN 12.0 ELSE greatest(12.0, x0 - greatest(8.0, (x1 - x0) * 0.04)) END AS cx0,
        CASE WHEN (x1 - x0) / 600 >= 0.68 THEN 588.0 ELSE least(588.0, x1 + greatest(8.0, (x1 - x0) * 0.04)) END AS cx1 FROM pr WHERE is_caption),
    low AS (SELECT c.doc_id, c.figure_key, max(p.y1) AS bottom FROM c JOIN pr p ON p.doc_id = c.doc_id AND p.page_idx = c.page_idx AND p.prose AND p.y1 < c.y0 - 5 - 8
        AND greatest(0, least(p.x1, cx1) - greatest(p.x0, cx0)) / greatest(1, least(p.x1 - p.x0, cx1 - cx0)) >= 0.5 GROUP BY ALL),
    s AS (SELECT c.*, 'same_page' AS mode, CASE WHEN bottom IS NULL OR y0 - 5 - (bottom + 6) < 70 THEN 12.0 ELSE bottom + 6 END AS ry0, y0 - 5 AS ry1 FROM c LEFT JOIN low USING (doc_id, figure_key)),
    lowp AS (SELECT c.doc_id, c.figure_key, max(p.y1) AS bottom FROM c JOIN pr p ON p.doc_id = c.doc_id AND p.page_idx = c.page_idx - 1 AND p.prose
        AND greatest(0, least(p.x1, cx1) - greatest(p.x0, cx0)) / greatest(1, least(p.x1 - p.x0, cx1 - cx0)) >= 0.45 GROUP BY ALL),
    v AS (SELECT c.* REPLACE (c.page_idx - 1 AS page_idx), 'previous_page' AS mode, coalesce(bottom + 8, 12.0) AS ry0, 788.0 AS ry1 FROM c LEFT JOIN lowp USING (doc_id, figure_key)
        WHERE c.page_idx > 0 AND (bottom IS NULL OR 788 - (bottom + 8) >= 90)),
    r AS (SELECT doc_id, figure_key, mode, page_idx, cx0 AS x0, ry0 AS y0, cx1 AS x1, ry1 AS y1 FROM s WHERE ry1 - ry0 >= 70 UNION ALL SELECT doc_id, figure_key, mode, page_idx, cx0, ry0, cx1, ry1 FROM v WHERE ry1 - ry0 >= 90)
    """
)


@query(_REGION_SQL + "SELECT doc_id, figure_key, mode, page_idx, CAST(x0 AS DOUBLE) AS x0, CAST(y0 AS DOUBLE) AS y0, CAST(x1 AS DOUBLE) AS x1, CAST(y1 AS DOUBLE) AS y1 FROM r")
def caption_regions(spark, folder):
    """Same-page and previous-page crop regions of every caption."""
    blocks = staged(layout.block_features(_layout(spark, folder, endmatter=False)), "layout-features")
    captions = layout.best_captions(blocks)
    both = layout.crop_regions(captions, blocks)
    return both.select("doc_id", "figure_key", "mode", "page_idx", *layout.BOX)


@query(
    _REGION_SQL
    + _DOC_PAGES_SQL
    + """
    , bx AS (SELECT doc_id, page_idx, 'text' AS kind, x0, y0, x1, y1, length(t) AS n, prose FROM pr
      UNION ALL SELECT doc_id, g, 'image', 60.0, 320.0, 60.0 + n_chars % 400, 420.0, 0, FALSE FROM np, range(0, n_pages) t(g)
      UNION ALL SELECT doc_id, g, 'drawing', 50.0, 300.0, 100.0 + n_chars % 400, 430.0, 0, FALSE FROM np, range(0, n_pages) t(g)),
    o AS (SELECT r.doc_id, r.figure_key, r.mode, kind, n, prose, (least(r.x1, bx.x1) - greatest(r.x0, bx.x0)) * (least(r.y1, bx.y1) - greatest(r.y0, bx.y0)) AS area
      FROM r JOIN bx ON r.doc_id = bx.doc_id AND r.page_idx = bx.page_idx AND least(r.x1, bx.x1) > greatest(r.x0, bx.x0) AND least(r.y1, bx.y1) > greatest(r.y0, bx.y0)),
    e AS (SELECT doc_id, figure_key, mode, count(*) FILTER (kind = 'image') AS raster_count, coalesce(sum(area) FILTER (kind = 'image'), 0) AS raster_area,
        count(*) FILTER (kind = 'drawing') AS drawing_count, count(*) FILTER (kind = 'text' AND n > 0 AND prose) AS prose_count,
        coalesce(sum(n) FILTER (kind = 'text' AND prose), 0) AS prose_chars, count(*) FILTER (kind = 'text' AND n > 0 AND NOT prose AND n <= 160) AS short_label_count FROM o GROUP BY ALL)
    SELECT r.doc_id, r.figure_key, r.mode, coalesce(raster_count, 0) AS raster_count, coalesce(drawing_count, 0) AS drawing_count, coalesce(prose_count, 0) AS prose_count,
      coalesce(short_label_count, 0) AS short_label_count,
      round(least(1.0, CAST(coalesce(raster_area, 0) AS DOUBLE) / CAST((r.x1 - r.x0) * (r.y1 - r.y0) AS DOUBLE)), 4) AS raster_fraction, round(CAST(r.y1 - r.y0 AS DOUBLE) / 800, 4) AS height_fraction,
      round(least(1.0, CAST(coalesce(raster_area, 0) AS DOUBLE) / CAST((r.x1 - r.x0) * (r.y1 - r.y0) AS DOUBLE)) * 8 + least(3.5, coalesce(raster_count, 0) * 0.75) + least(4.0, coalesce(drawing_count, 0) * 0.12)
        + least(2.0, coalesce(short_label_count, 0) * 0.12) + least(1.2, CAST(r.y1 - r.y0 AS DOUBLE) / 800 * 1.6) - least(4.5, coalesce(prose_count, 0) * 1.15) - least(2.0, coalesce(prose_chars, 0) / CAST(900.0 AS DOUBLE)), 4) AS score
    FROM r LEFT JOIN e USING (doc_id, figure_key, mode)
    """
)
def region_evidence(spark, folder):
    """Evidence counts and score of every crop region."""
    blocks = staged(layout.block_features(_layout(spark, folder, endmatter=False)), "layout-features")
    captions = layout.best_captions(blocks)
    both = layout.crop_regions(captions, blocks)
    scored = layout.visual_evidence(both, blocks)
    counts = ["raster_count", "drawing_count", "prose_count", "short_label_count"]
    return scored.select("doc_id", "figure_key", "mode", *counts, "raster_fraction", "height_fraction", "score")


# All blocks of the derived layouts with their features.
_BLOCKS_SQL = (
    _LAYOUT_SQL
    + _DOC_PAGES_SQL
    + r"""
    , boxes AS (SELECT doc_id, page_idx, block_id, 'text' AS kind, x0, y0, x1, y1, t, words, prose, CASE WHEN is_caption THEN CAST(regexp_extract(t, '^Figure ([0-9]+)', 1) AS INT) END AS fno FROM pr
      UNION ALL SELECT doc_id, CAST(g AS INT), 2000000, 'image', 60.0, 320.0, 60.0 + n_chars % 400, 420.0, '', 0, FALSE, NULL FROM np, range(0, n_pages) t(g)
      UNION ALL SELECT doc_id, CAST(g AS INT), 2000001, 'drawing', 50.0, 300.0, 100.0 + n_chars % 400, 430.0, '', 0, FALSE, NULL FROM np, range(0, n_pages) t(g)
      UNION ALL SELECT doc_id, n_pages, 2000002, 'image', 100.0, 100.0, 300.0 + (n_chars % 400) / 2, 500.0, '', 0, FALSE, NULL FROM np WHERE lang = 'en'
      UNION ALL SELECT doc_id, n_pages, 2000003, 'text', 100.0, 510.0, 180.0, 525.0, 'Figure 1', 2, FALSE, 1 FROM np WHERE lang = 'en'),
    ab AS (SELECT doc_id, page_idx, block_id, kind, CAST(x0 AS DOUBLE) AS x0, CAST(y0 AS DOUBLE) AS y0, CAST(x1 AS DOUBLE) AS x1, CAST(y1 AS DOUBLE) AS y1, t, length(t) AS n, words, prose, fno FROM boxes)
    """
)


def _best_captions_sql(bonus: int) -> str:
    return f"""SELECT *, 'fig' || fno AS figure_key FROM ab WHERE fno IS NOT NULL
      QUALIFY row_number() OVER (PARTITION BY doc_id, fno ORDER BY n + CASE WHEN contains(t, '(A)') THEN {bonus} ELSE 0 END DESC, page_idx, block_id) = 1"""


@query(
    _BLOCKS_SQL
    + f", c AS ({_best_captions_sql(300)})"
    + r"""
    , k AS (SELECT *, CASE WHEN (x1 - x0) / 600 >= 0.68 THEN 12.0 ELSE greatest(12.0, x0 - greatest(8.0, (x1 - x0) * 0.04)) END AS cx0,
        CASE WHEN (x1 - x0) / 600 >= 0.68 THEN 588.0 ELSE least(588.0, x1 + greatest(8.0, (x1 - x0) * 0.04)) END AS cx1 FROM c),
    above AS (SELECT k.doc_id, k.figure_key, max(p.y1) AS bottom FROM k JOIN ab p ON p.doc_id = k.doc_id AND p.page_idx = k.page_idx AND p.prose AND p.y1 < k.y0 - 13
        AND greatest(0, least(p.x1, cx1) - greatest(p.x0, cx0)) / greatest(1, least(p.x1 - p.x0, cx1 - cx0)) >= 0.5 GROUP BY ALL),
    before AS (SELECT k.doc_id, k.figure_key, max(p.y1) AS bottom FROM k JOIN ab p ON p.doc_id = k.doc_id AND p.page_idx = k.page_idx - 1 AND p.prose
        AND greatest(0, least(p.x1, cx1) - greatest(p.x0, cx0)) / greatest(1, least(p.x1 - p.x0, cx1 - cx0)) >= 0.45 GROUP BY ALL),
    same AS (SELECT k.doc_id, k.figure_key, 'same_page' AS mode, page_idx, cx0 AS x0, CASE WHEN bottom IS NULL OR y0 - 5 - (bottom + 6) < 70 THEN 12.0 ELSE bottom + 6 END AS y0, cx1 AS x1, y0 - 5 AS y1
        FROM k LEFT JOIN above USING (doc_id, figure_key)),
    prev AS (SELECT k.doc_id, k.figure_key, 'previous_page' AS mode, page_idx - 1 AS page_idx, cx0 AS x0, coalesce(bottom + 8, 12.0) AS y0, cx1 AS x1, 788.0 AS y1
        FROM k LEFT JOIN before USING (doc_id, figure_key) WHERE page_idx > 0 AND (bottom IS NULL OR 788 - (bottom + 8) >= 90)),
    tail AS (SELECT ab.*, CASE WHEN n <= 90 AND words <= 16 THEN fno END AS label_no,
        (kind = 'image' AND (x1 - x0) * (y1 - y0) >= 900) OR (kind = 'drawing' AND (x1 - x0) * (y1 - y0) >= 80) AS visual,
        n <= 100 AND regexp_matches(t, '(?i)^\s*table\s+\d+') AS is_table
        FROM ab JOIN (SELECT doc_id, max(page_idx) AS l FROM c GROUP BY 1) USING (doc_id) WHERE page_idx > l),
    ends AS (SELECT doc_id, page_idx, arg_min(label_no, block_id) FILTER (label_no IS NOT NULL) AS num, bool_or(is_table) AS is_table, min(x0) FILTER (visual) AS x0, min(y0) FILTER (visual) AS y0,
        max(x1) FILTER (visual) AS x1, max(y1) FILTER (visual) AS y1 FROM tail GROUP BY ALL),
    bounds AS (SELECT * FROM ends WHERE x0 IS NOT NULL AND (num IS NOT NULL OR NOT is_table)),
    near AS (SELECT e.doc_id, e.page_idx, min(b.x0) AS tx0, min(b.y0) AS ty0, max(b.x1) AS tx1, max(b.y1) AS ty1
        FROM bounds e JOIN tail b ON b.doc_id = e.doc_id AND b.page_idx = e.page_idx AND b.kind = 'text' AND b.n > 0 AND NOT b.prose AND b.n <= 180
        AND least(b.x1, least(e.x1 + 28, 600)) > greatest(b.x0, greatest(e.x0 - 28, 0)) AND least(b.y1, least(e.y1 + 59, 800)) > greatest(b.y0, greatest(e.y0 - 59, 0)) GROUP BY ALL),
    away AS (SELECT doc_id, '' AS figure_key, 'detached' AS mode, page_idx, greatest(least(x0, coalesce(tx0, x0)) - 14, 0) AS x0, greatest(least(y0, coalesce(ty0, y0)) - 14, 0) AS y0,
        least(greatest(x1, coalesce(tx1, x1)) + 14, 600) AS x1, least(greatest(y1, coalesce(ty1, y1)) + 14, 800) AS y1, num FROM bounds LEFT JOIN near USING (doc_id, page_idx)),
    r AS (SELECT *, NULL AS num FROM same WHERE y1 - y0 >= 70 AND x1 - x0 >= 60 UNION ALL SELECT *, NULL FROM prev WHERE y1 - y0 >= 90 AND x1 - x0 >= 60
        UNION ALL SELECT * FROM away WHERE x1 - x0 >= 80 AND y1 - y0 >= 80),
    o AS (SELECT r.doc_id, r.figure_key, r.mode, r.page_idx, b.kind, b.n, b.prose, (least(r.x1, b.x1) - greatest(r.x0, b.x0)) * (least(r.y1, b.y1) - greatest(r.y0, b.y0)) AS area
        FROM r JOIN ab b ON r.doc_id = b.doc_id AND r.page_idx = b.page_idx AND least(r.x1, b.x1) > greatest(r.x0, b.x0) AND least(r.y1, b.y1) > greatest(r.y0, b.y0)),
    e AS (SELECT doc_id, figure_key, mode, page_idx, count(*) FILTER (kind = 'image') AS rasters, coalesce(sum(area) FILTER (kind = 'image'), 0) AS raster_area, count(*) FILTER (kind = 'drawing') AS drawings,
        count(*) FILTER (kind = 'text' AND n > 0 AND prose) AS proses, coalesce(sum(n) FILTER (kind = 'text' AND prose), 0) AS prose_chars,
        count(*) FILTER (kind = 'text' AND n > 0 AND NOT prose AND n <= 160) AS shorts FROM o GROUP BY ALL),
    g AS (SELECT r.*, coalesce(rasters, 0) AS rasters, coalesce(drawings, 0) AS drawings, (x1 - x0) * (y1 - y0) / 480000 AS share,
        round(least(1.0, coalesce(raster_area, 0) / ((x1 - x0) * (y1 - y0))) * 8 + least(3.5, coalesce(rasters, 0) * 0.75) + least(4.0, coalesce(drawings, 0) * 0.12) + least(2.0, coalesce(shorts, 0) * 0.12)
          + least(1.2, (y1 - y0) / 800 * 1.6) - least(4.5, coalesce(proses, 0) * 1.15) - least(2.0, coalesce(prose_chars, 0) / CAST(900.0 AS DOUBLE)), 4) AS score
        FROM r LEFT JOIN e USING (doc_id, figure_key, mode, page_idx)),
    ok AS (SELECT * FROM g WHERE mode = 'detached' AND (rasters >= 1 OR (drawings >= 1 AND share >= 0.16)) AND score >= CASE WHEN num IS NOT NULL THEN 0.20 ELSE 0.95 END AND share >= 0.10),
    named AS (SELECT ok.* EXCLUDE (figure_key), c.figure_key, 'explicit_label' AS conf FROM ok JOIN c ON c.doc_id = ok.doc_id AND c.fno = ok.num
        QUALIFY row_number() OVER (PARTITION BY ok.doc_id, c.figure_key ORDER BY ok.score DESC, ok.page_idx) = 1),
    oc AS (SELECT doc_id, figure_key, row_number() OVER (PARTITION BY doc_id ORDER BY fno) AS i, count(*) OVER (PARTITION BY doc_id) AS m FROM c WHERE NOT EXISTS (SELECT 1 FROM named x WHERE x.doc_id = c.doc_id AND x.figure_key = c.figure_key)),
    op AS (SELECT * EXCLUDE (figure_key), row_number() OVER (PARTITION BY doc_id ORDER BY page_idx) AS i, count(*) OVER (PARTITION BY doc_id) AS m FROM ok WHERE num IS NULL),
    d AS (SELECT doc_id, figure_key, page_idx, x0, y0, x1, y1, score, conf FROM named
        UNION ALL SELECT oc.doc_id, oc.figure_key, op.page_idx, x0, y0, x1, y1, score, 'sequential_exact' FROM oc JOIN op ON oc.doc_id = op.doc_id AND oc.i = op.i AND oc.m = op.m),
    w AS (SELECT c.doc_id, c.figure_key, c.fno, c.t, c.page_idx AS cp, c.y0 / 800 AS h, s AS s, p AS p, d AS d,
        CASE WHEN s IS NULL THEN p WHEN p IS NULL THEN s WHEN (c.y0 / 800 <= 0.22 AND p.score >= 0.75 AND p.score >= s.score - 0.75) OR (c.y0 / 800 <= 0.36 AND p.score >= s.score + 0.60) OR (s.score < 0.80 AND p.score >= 1.75) THEN p ELSE s END AS near
        FROM c LEFT JOIN (SELECT * FROM g WHERE mode = 'same_page') s ON s.doc_id = c.doc_id AND s.figure_key = c.figure_key
        LEFT JOIN (SELECT * FROM g WHERE mode = 'previous_page') p ON p.doc_id = c.doc_id AND p.figure_key = c.figure_key LEFT JOIN d ON d.doc_id = c.doc_id AND d.figure_key = c.figure_key),
    z AS (SELECT *, d IS NOT NULL AND (near IS NULL OR coalesce(d.page_idx > cp AND ((d.conf = 'explicit_label' AND d.score >= 0.20) OR (d.conf = 'sequential_exact' AND d.score >= 0.95 AND (near.score < 2.40 OR d.score >= near.score - 0.35))), FALSE)) AS use
        FROM w WHERE near IS NOT NULL OR d IS NOT NULL)
    SELECT doc_id, 'Fig. ' || fno AS figure_label, figure_key, fno AS figure_no, t AS caption, CASE WHEN use THEN d.page_idx ELSE near.page_idx END + 1 AS figure_page_number, cp + 1 AS caption_page_number,
      round(CASE WHEN use THEN d.x0 ELSE near.x0 END, 2) AS crop_x0, round(CASE WHEN use THEN d.y0 ELSE near.y0 END, 2) AS crop_y0, round(CASE WHEN use THEN d.x1 ELSE near.x1 END, 2) AS crop_x1,
      round(CASE WHEN use THEN d.y1 ELSE near.y1 END, 2) AS crop_y1, CASE WHEN use THEN 'detached_endmatter' ELSE near.mode END AS selection_mode, CASE WHEN use THEN d.score ELSE near.score END AS selection_score,
      CASE WHEN use THEN 'original_pdf_detached_endmatter' WHEN near.mode = 'same_page' THEN 'original_pdf_caption_anchor_direct' ELSE 'original_pdf_caption_anchor_cross_page' END AS asset_mode,
      CASE WHEN use THEN d.page_idx ELSE near.page_idx END <> cp AS cross_page, use AS detached_endmatter, CASE WHEN use THEN d.conf ELSE 'local' END AS match_confidence FROM z
    """
)
def figure_table(spark, folder):
    """Figures of all derived layouts."""
    return layout.figure_table(_layout(spark, folder))


@query(
    _BLOCKS_SQL
    + r"""
    , c AS (SELECT *, 'fig' || fno AS figure_key FROM ab WHERE regexp_matches(t, '^Figure \d+[A-Za-z]?\s*[.:]?\s+') QUALIFY row_number() OVER (PARTITION BY doc_id, fno ORDER BY
        10.0 + CASE WHEN n BETWEEN 60 AND 2500 THEN 3.0 ELSE 0 END + 2.0 + CASE WHEN regexp_matches(t, '(?i)[A-H]\s+(and|–|-)\s+[A-H]') THEN 1.0 ELSE 0 END + CASE WHEN y0 > 200 THEN 0.5 ELSE 0 END DESC, n DESC, page_idx, block_id) = 1),
    k AS (SELECT *, CASE WHEN (x1 - x0) / 600 >= 0.70 THEN 14.0 ELSE greatest(14.0, x0 - greatest(8.0, (x1 - x0) * 0.05)) END AS cx0,
        CASE WHEN (x1 - x0) / 600 >= 0.70 THEN 586.0 ELSE least(586.0, x1 + greatest(8.0, (x1 - x0) * 0.05)) END AS cx1 FROM c),
    body AS (SELECT doc_id, page_idx, x0, y0, x1, y1 FROM (SELECT *, len(regexp_extract_all(t, '[.,;:]')) AS punct FROM ab)
        WHERE kind = 'text' AND n >= 120 AND punct >= 2 AND words >= 22 AND NOT regexp_matches(t, '^Figure \d+[A-Za-z]?\s*[.:]?\s+')),
    low AS (SELECT k.doc_id, k.figure_key, max(p.y1) AS bottom FROM k JOIN body p ON p.doc_id = k.doc_id AND p.page_idx = k.page_idx AND p.y1 < k.y0 - 8
        AND greatest(0, least(p.x1, cx1) - greatest(p.x0, cx0)) / greatest(1, least(p.x1 - p.x0, cx1 - cx0)) >= 0.45 GROUP BY ALL),
    im AS (SELECT k.doc_id, k.figure_key, min(b.y0) AS iy, min(b.x0) AS ix0, max(b.x1) AS ix1 FROM k JOIN ab b ON b.doc_id = k.doc_id AND b.page_idx = k.page_idx AND b.kind = 'image' AND b.y0 < k.y0
        AND greatest(0, least(b.x1, cx1) - greatest(b.x0, cx0)) / greatest(1, least(b.x1 - b.x0, cx1 - cx0)) >= 0.25 GROUP BY ALL),
    q AS (SELECT doc_id, figure_key, page_idx, k.y0 - 6 AS ry1, cx0, cx1, ix0, ix1, coalesce(ix1 - ix0 < 432, FALSE) AS widen,
        greatest(CASE WHEN bottom IS NULL THEN 14.0 ELSE least(k.y0 - 45, bottom + 8) END, coalesce(iy - 18, -1e9)) AS ry0 FROM k LEFT JOIN low USING (doc_id, figure_key) LEFT JOIN im USING (doc_id, figure_key))
    SELECT doc_id, figure_key, 'image_guided' AS mode, page_idx, CAST(CASE WHEN widen THEN greatest(12.0, least(cx0, ix0 - 10)) ELSE cx0 END AS DOUBLE) AS x0, CAST(ry0 AS DOUBLE) AS y0,
      CAST(CASE WHEN widen THEN least(588.0, greatest(cx1, ix1 + 10)) ELSE cx1 END AS DOUBLE) AS x1, CAST(ry1 AS DOUBLE) AS y1, CAST(600.0 AS DOUBLE) AS page_w, CAST(800.0 AS DOUBLE) AS page_h
    FROM q WHERE ry1 - ry0 >= 45
    """
)
def image_guided_regions(spark, folder):
    """Variant regions that start at the images above a caption."""
    blocks = staged(_layout(spark, folder), "layout-blocks")
    return layout.image_guided_regions(layout.best_captions_heuristic(blocks), blocks)


_FOUND = "doc_id, figure_key, figure_page_number, crop_x0, crop_y0, crop_x1, crop_y1, selection_mode"


@query(
    f"""
    WITH lang_of AS (SELECT CAST(doc_id AS VARCHAR) AS doc_id, lang FROM documents),
    first AS (SELECT f.* FROM ({ORACLES["figure_table"]}) f JOIN lang_of USING (doc_id) WHERE lang <> 'fr'),
    second AS (SELECT doc_id, figure_key, page_idx + 1 AS figure_page_number, round(x0, 2) AS crop_x0, round(y0, 2) AS crop_y0, round(x1, 2) AS crop_x1, round(y1, 2) AS crop_y1, mode AS selection_mode
      FROM ({ORACLES["image_guided_regions"]}))
    SELECT {_FOUND}, 'primary' AS engine FROM first UNION ALL SELECT {_FOUND}, 'fallback' FROM second WHERE doc_id NOT IN (SELECT doc_id FROM first)
    """
)
def preferred_figures(spark, folder):
    """Figures of both engines by preference; the first engine has no layout of the French documents."""
    blocks = staged(_layout(spark, folder), "layout-blocks")
    french = table(spark, folder, "documents").where("lang = 'fr'").select(F.col("doc_id").cast("string").alias("doc_id"))
    found = layout.preferred_figures(blocks.join(french, "doc_id", "left_anti"), blocks)
    return found.select(*_FOUND.split(", "), "engine")


@query(_BLOCKS_SQL + f", c AS ({_best_captions_sql(250)}) SELECT doc_id, fno AS figure_no, page_idx, sha256(t) AS caption_hash FROM c WHERE fno = 1 + CAST(doc_id AS BIGINT) % 3")
def caption_anchor(spark, folder):
    """The caption of one figure number of every document, looked for in the whole document."""
    asked = table(spark, folder, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), (1 + F.col("doc_id") % 3).cast("int").alias("figure_no"))
    found = layout.caption_anchor(_layout(spark, folder), asked)
    return found.select("doc_id", "figure_no", "page_idx", F.sha2("caption", 256).alias("caption_hash"))


@query(
    _LAYOUT_SQL
    + _DOC_PAGES_SQL
    + r"""
    , tail AS (SELECT doc_id, n_pages AS page_idx, 2000003 AS block_id, 510.0 AS y0, 'Figure 1' AS t FROM np WHERE lang = 'en'),
    c AS (SELECT doc_id, page_idx, block_id, y0, t FROM pr WHERE regexp_matches(t, '^Figure \d+[A-Za-z]?\s*[.:]?\s+')),
    s AS (SELECT doc_id, page_idx, block_id, length(t) AS n, 'fig' || regexp_extract(t, '^Figure ([0-9]+)', 1) AS figure_key,
        10.0 + CASE WHEN length(t) BETWEEN 60 AND 2500 THEN 3.0 ELSE 0 END + 2.0 + CASE WHEN regexp_matches(t, '(?i)\b[A-H]\s+(and|–|-)\s+[A-H]\b') THEN 1.0 ELSE 0 END
        + CASE WHEN y0 > 200 THEN 0.5 ELSE 0 END AS score FROM c)
    SELECT doc_id, figure_key, page_idx, CAST(score AS DOUBLE) AS score FROM s QUALIFY row_number() OVER (PARTITION BY doc_id, figure_key ORDER BY score DESC, n DESC, page_idx, block_id) = 1
    """
)
def best_per_key_scored(spark, folder):
    """Best caption per figure by the point score."""
    return layout.best_captions_heuristic(_layout(spark, folder)).select("doc_id", "figure_key", "page_idx", "score")


@query(
    """
    SELECT doc_id, lang, length(text) AS n_chars FROM documents QUALIFY row_number() OVER (PARTITION BY source, lang ORDER BY length(text) DESC, doc_id) = 1
    """
)
def longest_per_key(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "source", "lang", "text")
    best = layout.longest_captions(docs, ["source", "lang"], "text", ["doc_id"])
    return best.select("doc_id", "lang", F.length("text").cast("bigint").alias("n_chars"))


@query(
    r"""
    WITH t AS (SELECT doc_id, lang, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM documents)
    SELECT CAST(doc_id AS VARCHAR) AS doc_id, 3 AS page_idx, CASE WHEN lang = 'en' THEN 'text' ELSE 'image' END AS kind, CAST(10.0 AS DOUBLE) AS x0, CAST(40.0 AS DOUBLE) AS y1, sha256(t) AS text_hash FROM t
    UNION ALL SELECT CAST(doc_id AS VARCHAR), 3, 'drawing', 1.0, 4.0, sha256('') FROM t
    """
)
def flatten_pages(spark, folder):
    """Nested page trees built from the documents and flattened to blocks; a block without a box is dropped."""
    words = F.split(F.trim(F.regexp_replace("text", r"\s+", " ")), " ")
    spans = F.transform(words, lambda w: F.struct(w.alias("text")))
    kind = F.when(F.col("lang") == "en", 0).otherwise(1)

    def block(box):
        return F.struct(kind.alias("type"), box.alias("bbox"), F.array(F.struct(spans.alias("spans"))).alias("lines"))

    numbers = F.array(*[F.lit(v) for v in (10.0, 20.0, 30.0, 40.0)])
    drawn = F.array(F.struct(F.array(*[F.lit(v) for v in (1.0, 2.0, 3.0, 4.0)]).alias("rect")))
    page = F.struct(
        F.lit(3).alias("page_idx"), F.lit(600.0).alias("width"), F.lit(800.0).alias("height"),
        F.array(block(numbers), block(F.slice(numbers, 1, 2))).alias("blocks"), drawn.alias("drawings"),
    )
    docs = table(spark, folder, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), F.array(page).alias("pages"))
    flat = layout_source.flatten_pages(docs)
    return flat.select("doc_id", "page_idx", "kind", "x0", "y1", F.sha2("text", 256).alias("text_hash"))


@query(
    r"""
    WITH d AS (SELECT doc_id, len(string_split(coalesce(text, ''), chr(10))) AS n, trim(regexp_replace(coalesce(text, ''), '[\s\x0B]+', ' ', 'g'), ' ') AS t FROM documents)
    SELECT CAST(doc_id AS VARCHAR) AS doc_id, sha256(trim('Figure 1. (A) (B) (C) ' || t, ' ')) AS caption_hash, CAST(10.0 AS DOUBLE) AS body_x0, CAST(10.0 + greatest(3, least(n, 80)) AS DOUBLE) AS body_x1,
      greatest(3, least(n, 80)) < 100 * 0.72 AS suspicious FROM d
    """
)
def flatten_middle(spark, folder):
    """Nested layout trees with captions and bodies; a body much narrower than a multi-panel caption is suspicious."""
    text = F.coalesce("text", F.lit(""))
    n = F.least(F.size(F.split(text, "\n")), F.lit(80)).cast("double")
    words = F.split(F.trim(F.regexp_replace(text, r"\s+", " ")), " ")
    none = F.lit(None).cast("array<double>")

    def span(text, box=none):
        return F.struct(box.alias("bbox"), text.alias("content"), F.lit(None).cast("string").alias("text"))

    def block(kind, box, line_box, spans):
        line = F.struct(line_box.alias("bbox"), spans.alias("spans"))
        return F.struct(F.lit(kind).alias("type"), box.alias("bbox"), F.array(line).alias("lines"))

    def numbers(*values):
        return F.array(*[v if not isinstance(v, float) else F.lit(v) for v in values])

    caption = block("image_caption", numbers(0.0, 90.0, 100.0, 99.0), none, F.concat(F.array(span(F.lit("Figure 1. (A) (B) (C)"))), F.transform(words, lambda w: span(w))))
    body = block("image_body", numbers(12.0, 10.0, 13.0, 20.0), numbers(10.0, 10.0, 11.0, 12.0), F.array(span(F.lit(""), numbers(10.0, 10.0, F.lit(10.0) + n, 12.0))))
    para = F.struct(F.lit("Image").alias("type"), none.alias("bbox"), F.array(caption, body).alias("blocks"))
    other = F.struct(F.lit("text").alias("type"), none.alias("bbox"), F.array(body).alias("blocks"))
    page = F.struct(F.lit(0).alias("page_idx"), numbers(100.0, 120.0).alias("page_size"), F.array(para, other).alias("para_blocks"))
    docs = table(spark, folder, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), F.array(page).alias("pdf_info"))
    flat = layout.with_panel_suspicion(layout_source.flatten_middle(docs))
    return flat.select(
        "doc_id", F.sha2("caption", 256).alias("caption_hash"), "body_x0", "body_x1", F.col("suspicious_multi_panel").alias("suspicious")
    )
