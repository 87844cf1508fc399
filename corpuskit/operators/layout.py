"""Figures of a page layout: captions, crop regions, visual evidence, detached figure pages.

Input everywhere is one flat table ``layout_blocks(doc_id, page_idx, block_id, kind, x0, y0, x1, y1, text, page_w, page_h)``
with kind text, image or drawing.  All joins are equality joins on (doc_id, page_idx) plus range predicates; a page is bounded by
paper, and Spark splits skewed documents at run time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuskit.functions.labels import figure_integer_key, figure_label_key, figure_label_search, panel_count
from corpuskit.functions.text import (
    CAPTION_START,
    CAPTION_START_LETTER,
    WS,
    is_body_prose,
    is_prose,
    strip,
    word_count,
)
from corpuskit.operators.linking import prefer_source
from corpuskit.operators.ordered import best_per_key, pair_in_order
from corpuskit.session import staged

# Page geometry (points), score weights and acceptance thresholds.
MARGIN, CAPTION_GAP, PROSE_GAP, PROSE_GAP_PREVIOUS, CLEARANCE = 12.0, 5.0, 6.0, 8.0, 8.0
MIN_REGION_WIDTH, MIN_SAME_HEIGHT, MIN_PREVIOUS_HEIGHT = 60.0, 70.0, 90.0
PANEL_A = r"(?i)\(\s*A\s*\)"
TABLE_LABEL = rf"(?i)^{WS}*table{WS}+\d+\b"
PAGE = ["doc_id", "page_idx"]
BOX = ["x0", "y0", "x1", "y1"]


# --- geometry ------------------------------------------------------------------------------------------------------


def horizontal_overlap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Shared width over the narrower of the two spans."""
    shared = F.greatest(F.lit(0.0), F.least(a1, b1) - F.greatest(a0, b0))
    return shared / F.greatest(F.lit(1.0), F.least(a1 - a0, b1 - b0))


def intersection_area(a: str, b: str) -> Column:
    """Area shared by the boxes of the join sides ``a`` and ``b``."""
    w = F.least(F.col(f"{a}.x1"), F.col(f"{b}.x1")) - F.greatest(F.col(f"{a}.x0"), F.col(f"{b}.x0"))
    h = F.least(F.col(f"{a}.y1"), F.col(f"{b}.y1")) - F.greatest(F.col(f"{a}.y0"), F.col(f"{b}.y0"))
    return F.when((w > 0) & (h > 0), w * h).otherwise(0.0)


def overlap_pairs(regions: DataFrame, blocks: DataFrame, on: list[str]) -> DataFrame:
    """Blocks that intersect a region of the same page, with the shared area.  Sides keep the aliases ``r`` and ``b``."""
    r, b = regions.alias("r"), blocks.alias("b")
    cond = F.lit(True)
    for c in on:
        cond = cond & (F.col(f"r.{c}") == F.col(f"b.{c}"))
    return r.join(b, cond).withColumn("overlap_area", intersection_area("r", "b")).where("overlap_area > 0")


def union_bbox(boxes: DataFrame, keys: list[str]) -> DataFrame:
    """Smallest box around all boxes of a key; boxes with a missing coordinate are ignored."""
    valid = F.lit(True)
    for c in BOX:
        valid = valid & F.col(c).isNotNull()
    return boxes.where(valid).groupBy(*keys).agg(
        F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1")
    )


def to_page_units(boxes: DataFrame) -> DataFrame:
    """Coordinates in page units from shares of the page, source page units or thousandths, tried in that order.

    Needs ``x0, y0, x1, y1, page_w, page_h, src_w, src_h``; boxes that fit none become null.
    """
    raw = [F.col(c) for c in BOX]

    def every(low: float, high: float) -> Column:
        cond = F.lit(True)
        for c in raw:
            cond = cond & c.between(low, high)
        return cond

    x0, y0, x1, y1 = raw
    in_source = (
        (F.col("src_w") > 0)
        & (F.col("src_h") > 0)
        & (F.greatest(x0, x1) <= F.col("src_w") * 1.25)
        & (F.greatest(y0, y1) <= F.col("src_h") * 1.25)
    )
    unit = F.when(every(-0.05, 1.05), "share").when(in_source, "source").when(every(-20, 1020), "thousandth")

    def scaled(c: str) -> Column:
        page, source = (F.col("page_w"), F.col("src_w")) if c[0] == "x" else (F.col("page_h"), F.col("src_h"))
        return (
            F.when(F.col("unit") == "share", F.col(c) * page)
            .when(F.col("unit") == "source", F.col(c) / source * page)
            .when(F.col("unit") == "thousandth", F.col(c) / 1000.0 * page)
        )

    return boxes.withColumn("unit", unit).withColumns({c: scaled(c) for c in BOX})


def _clipped(df: DataFrame) -> DataFrame:
    """Box cut to its page."""
    w, h = F.col("page_w"), F.col("page_h")
    return df.withColumns(
        {
            "x0": F.greatest("x0", F.lit(0.0)),
            "y0": F.greatest("y0", F.lit(0.0)),
            "x1": F.least(F.col("x1"), w),
            "y1": F.least(F.col("y1"), h),
        }
    )


def pages_of(blocks: DataFrame) -> DataFrame:
    return blocks.groupBy(*PAGE).agg(F.max("page_w").alias("page_w"), F.max("page_h").alias("page_h"))


# --- captions ------------------------------------------------------------------------------------------------------


def block_features(blocks: DataFrame) -> DataFrame:
    """Blocks with everything the later steps ask of their text, so that the text itself is read once.

    ``figure_no`` and ``caption`` are set only for text blocks that start with a figure number (references inside prose never
    match), ``label_no`` only for short ones.
    """
    is_text = F.col("kind") == "text"
    body = blocks.withColumn("__body", F.when(is_text, strip("text")).otherwise(""))
    text = F.col("__body")
    figure_no = F.regexp_extract(text, CAPTION_START, 1).try_cast("int")
    short = (F.length(text) <= 90) & (word_count(text) <= 16)
    marked = body.withColumns({"n_chars": F.length(text), "prose": is_text & is_prose(text), "figure_no": figure_no})
    return marked.select(
        *PAGE, "block_id", "kind", *BOX, "page_w", "page_h", "n_chars", "prose", "figure_no",
        F.when(F.col("figure_no").isNotNull(), text).alias("caption"),
        F.when(short, F.col("figure_no")).alias("label_no"),
        ((F.col("n_chars") <= 100) & text.rlike(TABLE_LABEL)).alias("table_label"),
    )


def _features(blocks: DataFrame) -> DataFrame:
    return blocks if "prose" in blocks.columns else block_features(blocks)


def caption_blocks(blocks: DataFrame) -> DataFrame:
    """Text blocks that start with a figure number."""
    found = _features(blocks).where("figure_no IS NOT NULL")
    return found.select(
        *PAGE, "block_id", *BOX, "page_w", "page_h", "figure_no", "caption", figure_integer_key(F.col("figure_no")).alias("figure_key")
    )


def best_captions(blocks: DataFrame, panel_bonus: int = 300) -> DataFrame:
    """Richest caption block per figure: text length, bonus where panel A is listed; first in the document on ties."""
    score = F.length("caption") + F.when(F.col("caption").rlike(PANEL_A), panel_bonus).otherwise(0)
    scored = caption_blocks(blocks).withColumn("score", score)
    return best_per_key(scored, ["doc_id", "figure_key"], [F.desc("score"), F.asc("page_idx"), F.asc("block_id")])


def caption_anchor(blocks: DataFrame, labels: DataFrame) -> DataFrame:
    """Caption block of each requested figure number (``labels(doc_id, figure_no)``) anywhere in the document."""
    return best_captions(blocks.join(labels.select("doc_id").distinct(), "doc_id", "left_semi"), 250).join(
        labels, ["doc_id", "figure_no"], "left_semi"
    )


def best_captions_heuristic(blocks: DataFrame) -> DataFrame:
    """Variant with letter suffixes and a point score; longer text, then document order break ties."""
    caption = F.col("caption")
    points = (
        F.lit(10.0)
        + F.when(F.length(caption).between(60, 2500), 3.0).otherwise(0.0)
        + F.when(caption.rlike(r"\(\s*[A-H]\s*\)"), 2.0).otherwise(0.0)
        + F.when(caption.rlike(r"(?i)\b[A-H]\s+(?:and|–|-)\s+[A-H]\b"), 1.0).otherwise(0.0)
        + F.when(F.col("y0") > F.col("page_h") * 0.25, 0.5).otherwise(0.0)
    )
    texts = blocks.where(F.col("kind") == "text").withColumn("caption", strip("text"))
    label = F.regexp_extract(caption, CAPTION_START_LETTER, 1)
    found = texts.where(caption.rlike(CAPTION_START_LETTER)).withColumns(
        {"figure_label": figure_label_search(label), "figure_key": figure_label_key(label), "score": points}
    )
    order = [F.desc("score"), F.length("caption").desc(), F.asc("page_idx"), F.asc("block_id")]
    return best_per_key(found.drop("text"), ["doc_id", "figure_key"], order)


def longest_captions(figures: DataFrame, keys: list[str], caption: str, tie: list[str]) -> DataFrame:
    """Longest caption per key."""
    return best_per_key(figures, keys, [F.length(caption).desc(), *[F.asc(t) for t in tie]])


# --- regions -------------------------------------------------------------------------------------------------------


def with_caption_column(
    captions: DataFrame, wide: float = 0.68, pad: float = 0.04, margin: float = MARGIN
) -> DataFrame:
    """Adds ``col_x0, col_x1``: the whole page for a wide caption, else the caption plus padding."""
    width = F.col("x1") - F.col("x0")
    padding = F.greatest(F.lit(8.0), width * pad)
    full = width / F.greatest(F.lit(1.0), F.col("page_w")) >= wide
    return captions.withColumns(
        {
            "col_x0": F.when(full, F.lit(margin)).otherwise(F.greatest(F.lit(margin), F.col("x0") - padding)),
            "col_x1": F.when(full, F.col("page_w") - margin).otherwise(
                F.least(F.col("page_w") - margin, F.col("x1") + padding)
            ),
        }
    )


REGION = ["doc_id", "figure_key", "mode", "page_idx", *BOX, "page_w", "page_h"]


def _lowest(targets: DataFrame, blocks: DataFrame) -> DataFrame:
    """Adds ``prose_bottom``: lower edge of the last block in the target's column above its ``limit``.

    The grouping keys include the join keys, so the aggregation reuses the partitioning of the join.
    """
    t, b = targets.alias("t"), blocks.alias("b")
    near = horizontal_overlap(F.col("b.x0"), F.col("b.x1"), F.col("t.col_x0"), F.col("t.col_x1")) >= F.col("t.min_overlap")
    on_page = (F.col("t.doc_id") == F.col("b.doc_id")) & (F.col("t.page_idx") == F.col("b.page_idx"))
    joined = t.join(b, on_page & near & (F.col("b.y1") < F.col("t.limit")), "left")
    return joined.groupBy(*[F.col(f"t.{c}") for c in targets.columns]).agg(F.max("b.y1").alias("prose_bottom"))


def _crop_targets(captions: DataFrame, blocks: DataFrame) -> DataFrame:
    """Where to look for the figure of a caption: above it in its column, and in the same column of the page before."""
    before = pages_of(blocks).select(
        "doc_id", (F.col("page_idx") + 1).alias("page_idx"), F.col("page_w").alias("prev_w"), F.col("page_h").alias("prev_h")
    )
    placed = with_caption_column(_clipped(captions)).join(before, PAGE, "left")
    scale = F.col("prev_w") / F.greatest(F.lit(1.0), F.col("page_w"))
    same = F.struct(
        F.lit("same_page").alias("mode"),
        F.col("page_idx"),
        F.col("page_w"),
        F.col("page_h"),
        F.col("col_x0"),
        F.col("col_x1"),
        (F.col("y0") - CAPTION_GAP).alias("bottom"),
        (F.col("y0") - CAPTION_GAP - CLEARANCE).alias("limit"),
        F.lit(0.50).alias("min_overlap"),
    )
    previous = F.struct(
        F.lit("previous_page").alias("mode"),
        (F.col("page_idx") - 1).alias("page_idx"),
        F.col("prev_w").alias("page_w"),
        F.col("prev_h").alias("page_h"),
        F.greatest(F.lit(MARGIN), F.col("col_x0") * scale).alias("col_x0"),
        F.least(F.col("prev_w") - MARGIN, F.col("col_x1") * scale).alias("col_x1"),
        (F.col("prev_h") - MARGIN).alias("bottom"),
        F.lit(float("inf")).alias("limit"),
        F.lit(0.45).alias("min_overlap"),
    )
    both = F.array_compact(F.array(same, F.when(F.col("prev_w").isNotNull(), previous)))
    return placed.select("doc_id", "figure_key", F.explode(both).alias("__t")).select("doc_id", "figure_key", "__t.*")


def crop_regions(captions: DataFrame, blocks: DataFrame) -> DataFrame:
    """Crop regions of the captions, one per mode, from one join with the prose blocks.

    ``same_page``: from the last prose block above the caption (or the margin, if less than 70 points are left) to the caption.
    ``previous_page``: from the last prose block of the page before to its bottom; dropped if less than 90 points are left.
    """
    features = _features(blocks)
    prose = features.where("prose").select(*PAGE, *BOX)
    low = _lowest(_crop_targets(captions, features), prose)
    same = F.col("mode") == "same_page"
    least_height = F.when(same, MIN_SAME_HEIGHT).otherwise(MIN_PREVIOUS_HEIGHT)
    top = F.col("prose_bottom") + F.when(same, PROSE_GAP).otherwise(PROSE_GAP_PREVIOUS)
    enough = F.col("bottom") - top >= least_height
    kept = low.where(same | F.col("prose_bottom").isNull() | enough)
    region = kept.withColumns(
        {
            "x0": F.col("col_x0"),
            "y0": F.when(enough, top).otherwise(MARGIN),
            "x1": F.col("col_x1"),
            "y1": F.col("bottom"),
        }
    )
    wide, high = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    return _clipped(region).where((wide >= MIN_REGION_WIDTH) & (high >= least_height)).select(*REGION)


def image_guided_regions(captions: DataFrame, blocks: DataFrame) -> DataFrame:
    """Variant: same-page region that starts at the images above the caption and widens to them.

    ``captions`` come from ``best_captions_heuristic``.
    """
    prose = blocks.where((F.col("kind") == "text") & is_body_prose("text")).select(*PAGE, *BOX)
    images = blocks.where(F.col("kind") == "image").select(*PAGE, *BOX)
    placed = with_caption_column(captions, wide=0.70, pad=0.05, margin=14.0).withColumns(
        {"cap_y0": F.col("y0"), "limit": F.col("y0") - CLEARANCE, "min_overlap": F.lit(0.45)}
    )
    low = _lowest(placed, prose)
    c, b = placed.alias("c"), images.alias("b")
    near = horizontal_overlap(F.col("b.x0"), F.col("b.x1"), F.col("c.col_x0"), F.col("c.col_x1")) >= 0.25
    on_page = (F.col("c.doc_id") == F.col("b.doc_id")) & (F.col("c.page_idx") == F.col("b.page_idx"))
    seen = (
        c.join(b, on_page & near & (F.col("b.y0") < F.col("c.cap_y0")))
        .groupBy(F.col("c.doc_id").alias("doc_id"), F.col("c.figure_key").alias("figure_key"))
        .agg(F.min("b.y0").alias("img_y0"), F.min("b.x0").alias("img_x0"), F.max("b.x1").alias("img_x1"))
    )
    rows = low.join(seen, ["doc_id", "figure_key"], "left")
    top = F.coalesce(F.least(F.col("cap_y0") - 45.0, F.col("prose_bottom") + 8.0), F.lit(14.0))
    top = F.when(F.col("prose_bottom").isNull(), 14.0).otherwise(top)
    top = F.when(F.col("img_y0").isNull(), top).otherwise(F.greatest(top, F.col("img_y0") - 18.0))
    widen = F.coalesce(F.col("img_x1") - F.col("img_x0") < F.col("page_w") * 0.72, F.lit(False))
    region = rows.withColumns(
        {
            "x0": F.when(widen, F.greatest(F.lit(12.0), F.least("col_x0", F.col("img_x0") - 10.0))).otherwise(F.col("col_x0")),
            "y0": top,
            "x1": F.when(widen, F.least(F.col("page_w") - 12.0, F.greatest("col_x1", F.col("img_x1") + 10.0))).otherwise(
                F.col("col_x1")
            ),
            "y1": F.col("cap_y0") - 6.0,
            "mode": F.lit("image_guided"),
        }
    )
    return region.where(F.col("y1") - F.col("y0") >= 45.0).select(*REGION)


def evidence_score(
    raster_area: Column, raster: Column, drawings: Column, short: Column, prose: Column, prose_chars: Column,
    area: Column, height: Column, page_h: Column, digits: int = 4,
) -> Column:
    """How figure-like a region is; every term is clamped."""
    raster_share = F.least(F.lit(1.0), raster_area / F.greatest(F.lit(1.0), area))
    height_share = F.least(F.lit(1.0), height / F.greatest(F.lit(1.0), page_h))
    return F.round(
        raster_share * 8.0
        + F.least(F.lit(3.5), raster * 0.75)
        + F.least(F.lit(4.0), drawings * 0.12)
        + F.least(F.lit(2.0), short * 0.12)
        + F.least(F.lit(1.2), height_share * 1.6)
        - F.least(F.lit(4.5), prose * 1.15)
        - F.least(F.lit(2.0), prose_chars / 900.0),
        digits,
    )


def visual_evidence(regions: DataFrame, blocks: DataFrame) -> DataFrame:
    """Regions with counts of what lies in them and the evidence score.

    One join by page; the grouping keys include the join keys, so the counts need no further shuffle.
    """
    body = _features(blocks).select(*PAGE, *BOX, "kind", "n_chars", "prose")
    r, b = regions.alias("r"), body.alias("b")
    area = intersection_area("r", "b")
    on_page = (F.col("r.doc_id") == F.col("b.doc_id")) & (F.col("r.page_idx") == F.col("b.page_idx"))
    kind, prose, chars = F.col("b.kind"), F.col("b.prose"), F.col("b.n_chars")
    text = (kind == "text") & (chars > 0)

    def count(cond: Column, name: str) -> Column:
        return F.count(F.when(cond, 1)).alias(name)

    counted = (
        r.join(b, on_page & (area > 0), "left")
        .groupBy(*[F.col(f"r.{c}") for c in regions.columns])
        .agg(
            count(kind == "image", "raster_count"),
            F.sum(F.when(kind == "image", area).otherwise(0.0)).alias("raster_area"),
            count(kind == "drawing", "drawing_count"),
            count(text & prose, "prose_count"),
            F.sum(F.when(text & prose, chars).otherwise(0)).alias("prose_chars"),
            count(text & ~prose & (chars <= 160), "short_label_count"),
        )
    )
    width, height = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    score = evidence_score(
        F.col("raster_area"), F.col("raster_count"), F.col("drawing_count"), F.col("short_label_count"),
        F.col("prose_count"), F.col("prose_chars"), width * height, height, F.col("page_h"),
    )
    shares = {
        "raster_fraction": F.round(F.least(F.lit(1.0), F.col("raster_area") / F.greatest(F.lit(1.0), width * height)), 4),
        "height_fraction": F.round(F.least(F.lit(1.0), height / F.greatest(F.lit(1.0), F.col("page_h"))), 4),
    }
    return counted.withColumns({"score": score, **shares})


# --- detached pages ------------------------------------------------------------------------------------------------


def detached_pages(blocks: DataFrame, captions: DataFrame) -> DataFrame:
    """Visual pages after the last caption of a document: figures appended at the end of a manuscript."""
    last = captions.groupBy("doc_id").agg(F.max("page_idx").alias("__last"))
    tail = _features(blocks).join(last, "doc_id").where("page_idx > __last").drop("__last")
    has_text = (F.col("kind") == "text") & (F.col("n_chars") > 0)
    area = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    visual = ((F.col("kind") == "image") & (area >= 900)) | ((F.col("kind") == "drawing") & (area >= 80))
    marked = tail.withColumn("__visual", visual)
    pages = marked.groupBy(*PAGE).agg(
        F.max("page_w").alias("page_w"),
        F.max("page_h").alias("page_h"),
        F.min_by("label_no", F.when(F.col("label_no").isNotNull(), F.col("block_id"))).alias("explicit_number"),
        F.bool_or("table_label").alias("__table"),
        *[F.min(F.when(F.col("__visual"), F.col(c))).alias(c) for c in ("x0", "y0")],
        *[F.max(F.when(F.col("__visual"), F.col(c))).alias(c) for c in ("x1", "y1")],
    )
    pages = pages.where("x0 IS NOT NULL AND (explicit_number IS NOT NULL OR NOT __table)").drop("__table")
    return _with_nearby_text(pages, marked.where(has_text & ~F.col("prose") & (F.col("n_chars") <= 180)))


def _grown(df: DataFrame, dx: float, dy: float) -> DataFrame:
    return _clipped(
        df.withColumns(
            {"x0": F.col("x0") - dx, "y0": F.col("y0") - dy, "x1": F.col("x1") + dx, "y1": F.col("y1") + dy}
        )
    )


def _with_nearby_text(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """Visual bounds of each page extended to the labels around them; bounds under 80 points are dropped."""
    reach = _grown(_grown(pages, 18, 24), 10, 35)
    around = (
        overlap_pairs(reach, labels.select(*PAGE, *BOX), PAGE)
        .groupBy(*[F.col(f"r.{c}").alias(c) for c in PAGE])
        .agg(
            *[F.min(f"b.{c}").alias(f"t_{c}") for c in ("x0", "y0")],
            *[F.max(f"b.{c}").alias(f"t_{c}") for c in ("x1", "y1")],
        )
    )
    joined = pages.join(around, PAGE, "left")
    wider = {c: (F.least if c in ("x0", "y0") else F.greatest)(F.col(c), F.col(f"t_{c}")) for c in BOX}
    bounds = _grown(joined.withColumns(wider).drop(*[f"t_{c}" for c in BOX]), 14, 14)
    return bounds.where((F.col("x1") - F.col("x0") >= 80) & (F.col("y1") - F.col("y0") >= 80))


def accept_detached(scored: DataFrame) -> DataFrame:
    """Detached pages with enough visual evidence."""
    share = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")) / F.greatest(
        F.lit(1.0), F.col("page_w") * F.col("page_h")
    )
    real = (F.col("raster_count") >= 1) | ((F.col("drawing_count") >= 1) & (F.col("area_fraction") >= 0.16))
    enough = F.col("score") >= F.when(F.col("explicit_number").isNotNull(), 0.20).otherwise(0.95)
    return scored.withColumn("area_fraction", share).where(real & enough & (F.col("area_fraction") >= 0.10))


def detached_map(candidates: DataFrame, captions: DataFrame) -> DataFrame:
    """Detached page of each caption: by its printed number, else in order where the counts left over are equal."""
    known = captions.select("doc_id", "figure_key", "figure_no")
    page = ["page_idx", *BOX, "page_w", "page_h", "score"]
    numbered = candidates.where("explicit_number IS NOT NULL").withColumnRenamed("explicit_number", "figure_no")
    explicit = best_per_key(
        numbered.join(known, ["doc_id", "figure_no"]), ["doc_id", "figure_key"], [F.desc("score"), F.asc("page_idx")]
    ).select("doc_id", "figure_key", *page, F.lit("explicit_label").alias("match_confidence"))
    open_captions = known.join(explicit, ["doc_id", "figure_key"], "left_anti")
    plain = candidates.where("explicit_number IS NULL").select("doc_id", *page)
    paired = pair_in_order(
        open_captions,
        plain,
        ["doc_id"],
        (["figure_no"], F.floor(F.col("figure_no") / 1024)),
        (["page_idx"], F.floor(F.col("page_idx") / 1024)),
    )
    return explicit.unionByName(
        paired.select("doc_id", "figure_key", *page, F.lit("sequential_exact").alias("match_confidence"))
    )


# --- selection -----------------------------------------------------------------------------------------------------


def choose_regions(captions: DataFrame, local: DataFrame, detached: DataFrame) -> DataFrame:
    """One region per caption: same page or previous page by the caption's height and the scores, then against a detached page."""
    on = ["doc_id", "figure_key"]
    region = F.struct("mode", "page_idx", *BOX, "score")
    near = local.groupBy(*on).agg(
        *[F.max(F.when(F.col("mode") == mode, region)).alias(name) for mode, name in (("same_page", "same"), ("previous_page", "prev"))]
    )
    away = detached.select(*on, F.struct("match_confidence", "page_idx", *BOX, "score").alias("away"))
    rows = captions.join(near, on, "left").join(away, on, "left")
    s, p = F.col("same.score"), F.col("prev.score")
    height = F.col("y0") / F.greatest(F.lit(1.0), F.col("page_h"))
    take_prev = (
        ((height <= 0.22) & (p >= 0.75) & (p >= s - 0.75)) | ((height <= 0.36) & (p >= s + 0.60)) | ((s < 0.80) & (p >= 1.75))
    )
    near = F.when(F.col("same").isNull(), F.col("prev")).when(F.col("prev").isNull(), F.col("same"))
    near = near.when(take_prev, F.col("prev")).otherwise(F.col("same"))
    rows = rows.withColumn("near", near)
    a, n = F.col("away.score"), F.col("near.score")
    take_away = (F.col("away.page_idx") > F.col("page_idx")) & (
        ((F.col("away.match_confidence") == "explicit_label") & (a >= 0.20))
        | ((F.col("away.match_confidence") == "sequential_exact") & (a >= 0.95) & ((n < 2.40) | (a >= n - 0.35)))
    )
    use_away = F.col("away").isNotNull() & (F.col("near").isNull() | take_away)
    chosen = F.when(use_away, F.struct("away.page_idx", *[f"away.{c}" for c in BOX], "away.score")).otherwise(
        F.struct("near.page_idx", *[f"near.{c}" for c in BOX], "near.score")
    )
    return rows.where(F.col("near").isNotNull() | F.col("away").isNotNull()).withColumns(
        {
            "region": chosen,
            "selection_mode": F.when(use_away, "detached_endmatter").otherwise(F.col("near.mode")),
            "match_confidence": F.when(use_away, F.col("away.match_confidence")).otherwise("local"),
        }
    )


# Asset mode names per selection mode.
ASSET_MODES = {
    "same_page": "original_pdf_caption_anchor_direct",
    "previous_page": "original_pdf_caption_anchor_cross_page",
    "detached_endmatter": "original_pdf_detached_endmatter",
}


def figure_table(blocks: DataFrame) -> DataFrame:
    """Figures of every document: caption, chosen region, how it was chosen and both page numbers.

    Features, captions and scored regions are staged: each is used several times, and the text is scanned only once.
    """
    features = staged(block_features(blocks), "layout-features")
    captions = staged(best_captions(features), "layout-captions")
    local = crop_regions(captions, features).withColumn("explicit_number", F.lit(None).cast("int"))
    pages = detached_pages(features, captions).withColumns({"figure_key": F.lit(""), "mode": F.lit("detached")})
    regions = local.unionByName(pages)
    scored = staged(visual_evidence(regions, features), "layout-regions")
    tail = scored.where("mode = 'detached'").drop("figure_key", "mode")
    detached = detached_map(accept_detached(tail), captions)
    chosen = choose_regions(captions.drop("score"), scored.where("mode != 'detached'"), detached)
    modes = F.create_map(*[F.lit(x) for pair in ASSET_MODES.items() for x in pair])
    return chosen.select(
        "doc_id",
        F.concat(F.lit("Fig. "), F.col("figure_no").cast("string")).alias("figure_label"),
        "figure_key",
        "figure_no",
        "caption",
        (F.col("region.page_idx") + 1).alias("figure_page_number"),
        (F.col("page_idx") + 1).alias("caption_page_number"),
        *[F.round(f"region.{c}", 2).alias(f"crop_{c}") for c in BOX],
        "selection_mode",
        F.col("region.score").alias("selection_score"),
        modes[F.col("selection_mode")].alias("asset_mode"),
        (F.col("region.page_idx") != F.col("page_idx")).alias("cross_page"),
        (F.col("selection_mode") == "detached_endmatter").alias("detached_endmatter"),
        "match_confidence",
    )


def image_guided_figures(blocks: DataFrame) -> DataFrame:
    """Figures as ``figure_table`` lists them, from the image-guided regions: always on the caption's page, without a score."""
    captions = staged(best_captions_heuristic(blocks), "guided-captions")
    regions = image_guided_regions(captions, blocks)
    named = captions.select("doc_id", "figure_key", "figure_label", "caption").join(regions, ["doc_id", "figure_key"])
    page = F.col("page_idx") + 1
    return named.select(
        "doc_id", "figure_label", "figure_key",
        F.regexp_extract("figure_key", r"(\d+)", 1).try_cast("int").alias("figure_no"),
        "caption", page.alias("figure_page_number"), page.alias("caption_page_number"),
        *[F.round(c, 2).alias(f"crop_{c}") for c in BOX],
        F.col("mode").alias("selection_mode"),
        F.lit(None).cast("double").alias("selection_score"),
        F.lit("pdf_image_guided_crop").alias("asset_mode"),
        F.lit(False).alias("cross_page"), F.lit(False).alias("detached_endmatter"),
        F.lit("local").alias("match_confidence"),
    )


def preferred_figures(blocks: DataFrame, other_blocks: DataFrame) -> DataFrame:
    """One figure table over two engines: ``figure_table`` of ``blocks`` for documents where it finds any figure, else the image-guided figures of
    ``other_blocks``, else none; with the ``engine`` that found them."""
    first = staged(figure_table(blocks), "figures")
    # the second engine works on what the first left, not on every document
    rest = staged(other_blocks.join(first.select("doc_id"), "doc_id", "left_anti"), "other-blocks")
    return prefer_source(first, image_guided_figures(rest), "doc_id")


def with_panel_suspicion(figures: DataFrame) -> DataFrame:
    """Flags figures whose body looks like one panel of several: three or more panels, body under 72 % of the caption width.

    Needs ``caption, body_x0, body_x1, cap_x0, cap_x1``.
    """
    body, cap = F.col("body_x1") - F.col("body_x0"), F.col("cap_x1") - F.col("cap_x0")
    return figures.withColumn("panel_count", panel_count("caption")).withColumn(
        "suspicious_multi_panel",
        F.coalesce((F.col("panel_count") >= 3) & (cap > 0) & (body < cap * 0.72), F.lit(False)),
    )
