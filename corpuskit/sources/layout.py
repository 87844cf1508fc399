"""Nested page layouts flattened to ``layout_blocks``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PAGE_TREE = (
    "doc_id string, pages array<struct<page_idx: int, width: double, height: double, blocks: array<struct<"
    "type: int, bbox: array<double>, lines: array<struct<spans: array<struct<text: string>>>>>>, "
    "drawings: array<struct<rect: array<double>>>>>"
)
MIDDLE_TREE = (
    "doc_id string, pdf_info array<struct<page_idx: int, page_size: array<double>, para_blocks: array<struct<"
    "type: string, bbox: array<double>, blocks: array<struct<type: string, bbox: array<double>, "
    "lines: array<struct<bbox: array<double>, spans: array<struct<bbox: array<double>, content: string, text: string>>>>"
    ">>>>>>"
)


def line_text(lines: Column, *fields: str) -> Column:
    """Non-empty span texts of all lines, joined by one blank."""

    def span_text(s: Column) -> Column:
        return F.coalesce(*[F.nullif(s[f], F.lit("")) for f in fields])

    spans = F.flatten(F.transform(lines, lambda l: F.coalesce(l["spans"], F.array())))
    return F.trim(F.array_join(F.transform(spans, span_text), " "))


def _box(c: Column) -> list[Column]:
    return [F.get(c, F.lit(i)).alias(n) for i, n in enumerate(("x0", "y0", "x1", "y1"))]


def flatten_pages(docs: DataFrame) -> DataFrame:
    """``PAGE_TREE`` rows to layout blocks.  Blocks without a four-number box are dropped: they have no place on the page."""
    pages = docs.select("doc_id", F.explode("pages").alias("p"))
    blocks = pages.select("doc_id", "p", F.posexplode("p.blocks").alias("block_id", "b")).where(F.size("b.bbox") == 4)
    texts = blocks.select(
        "doc_id", "p.page_idx", "block_id",
        F.when(F.col("b.type") == 0, "text").when(F.col("b.type") == 1, "image").alias("kind"),
        *_box(F.col("b.bbox")),
        F.coalesce(line_text(F.col("b.lines"), "text"), F.lit("")).alias("text"),
        F.col("p.width").alias("page_w"), F.col("p.height").alias("page_h"),
    ).where("kind IS NOT NULL")
    drawn = pages.select("doc_id", "p", F.posexplode("p.drawings").alias("n", "d")).where(F.size("d.rect") == 4)
    drawings = drawn.select(
        "doc_id", "p.page_idx", (F.lit(1_000_000) + F.col("n")).alias("block_id"), F.lit("drawing").alias("kind"),
        *_box(F.col("d.rect")), F.lit("").alias("text"), F.col("p.width").alias("page_w"), F.col("p.height").alias("page_h"),
    )
    return texts.unionByName(drawings)


def flatten_middle(docs: DataFrame) -> DataFrame:
    """``MIDDLE_TREE`` rows to one row per image or chart: caption text, and the boxes of caption and body.

    Body geometry is the union of block, line and span boxes, because several panels often have only the inner ones.
    """
    pages = docs.select("doc_id", F.explode("pdf_info").alias("p"))
    paras = pages.select("doc_id", "p", F.posexplode("p.para_blocks").alias("para_id", "a")).where(
        F.lower("a.type").isin("image", "chart")
    )
    none = F.array().cast("array<array<double>>")

    def of(kind: str) -> Column:
        return F.filter("a.blocks", lambda b: F.lower(b["type"]).isin(f"image_{kind}", f"chart_{kind}"))

    def inner(b: Column) -> Column:
        lines = F.coalesce(b["lines"], F.array())
        own = F.concat(F.array(b["bbox"]), F.transform(lines, lambda l: l["bbox"]))
        spans = F.flatten(F.transform(lines, lambda l: F.transform(F.coalesce(l["spans"], F.array()), lambda s: s["bbox"])))
        return F.concat(own, spans)

    def union(boxes: Column, prefix: str) -> list[Column]:
        valid = F.filter(boxes, lambda b: F.size(b) == 4)
        return [
            (F.array_min if i < 2 else F.array_max)(F.transform(valid, lambda b: b[i])).alias(f"{prefix}_{n}")
            for i, n in enumerate(("x0", "y0", "x1", "y1"))
        ]

    caption = F.array_join(F.filter(F.transform(of("caption"), lambda b: line_text(b["lines"], "content", "text")), lambda t: t != ""), " ")
    return paras.select(
        "doc_id",
        F.coalesce("p.page_idx", F.lit(0)).alias("page_idx"),
        "para_id",
        F.get("p.page_size", F.lit(0)).alias("src_w"),
        F.get("p.page_size", F.lit(1)).alias("src_h"),
        F.trim(caption).alias("caption"),
        *union(F.transform(of("caption"), lambda b: b["bbox"]), "cap"),
        *union(F.coalesce(F.flatten(F.transform(of("body"), inner)), none), "body"),
    )
