"""Figure selection on hand-made page layouts."""

import pytest
from pyspark.sql import functions as F

from corpuskit.operators import layout

SCHEMA = "doc_id string, page_idx int, block_id int, kind string, x0 double, y0 double, x1 double, y1 double, text string, page_w double, page_h double"
PROSE = "This is ordinary article prose with plenty of words, and it continues for some time so that it counts, as real text does. "
CAPTION = "Figure {}. Overview of the assay. (A) First panel. (B) Second panel."


class Pages:
    def __init__(self):
        self.rows = []

    def add(self, doc, page, kind, box, text=""):
        self.rows.append((doc, page, len(self.rows), kind, *map(float, box), text, 600.0, 800.0))


@pytest.fixture(scope="module")
def blocks(spark):
    p = Pages()
    # same page: prose, image, caption; a reference inside prose is no caption; a stray heading loses against the caption
    p.add("same", 0, "text", (40, 40, 560, 120), PROSE + "see (Fig. 7A).")
    p.add("same", 0, "image", (60, 140, 540, 480))
    p.add("same", 0, "text", (40, 500, 560, 560), CAPTION.format(1))
    p.add("same", 0, "text", (40, 700, 560, 710), "Figure 1")
    # previous page: image at the bottom of page 0, caption at the top of page 1
    p.add("prev", 0, "text", (40, 40, 560, 200), PROSE)
    p.add("prev", 0, "image", (40, 230, 560, 780))
    p.add("prev", 1, "text", (40, 100, 560, 150), CAPTION.format(2))
    p.add("prev", 1, "text", (40, 200, 560, 400), PROSE)
    # detached and labelled, in the wrong order; a table page in between
    for n in (1, 2):
        p.add("labelled", 0, "text", (40, 150 + 300 * n, 560, 190 + 300 * n), CAPTION.format(n))
        p.add("labelled", 0, "text", (40, 50 + 300 * n, 560, 140 + 300 * n), PROSE)
    for page, label in ((1, "Figure 2"), (2, "Table 1"), (3, "Figure 1")):
        p.add("labelled", page, "image", (100, 100, 500, 600))
        p.add("labelled", page, "text", (100, 610, 200, 620), label)
    # detached without labels: equal counts are paired in order, unequal ones are not
    for doc, n_pages in (("equal", 2), ("unequal", 3)):
        for n in (1, 2):
            p.add(doc, 0, "text", (40, 150 + 300 * n, 560, 190 + 300 * n), CAPTION.format(n))
            p.add(doc, 0, "text", (40, 50 + 300 * n, 560, 140 + 300 * n), PROSE)
        for page in range(1, n_pages + 1):
            p.add(doc, page, "image", (50, 50, 550, 700))
    return spark.createDataFrame(p.rows, SCHEMA)


@pytest.fixture(scope="module")
def figures(blocks):
    return {(r["doc_id"], r["figure_no"]): r for r in layout.figure_table(blocks).collect()}


def test_captions_start_the_block(blocks):
    best = {(r["doc_id"], r["figure_no"]): r for r in layout.best_captions(blocks).collect()}
    assert ("same", 7) not in best
    assert best[("same", 1)]["caption"] == CAPTION.format(1)


def test_same_page(figures):
    row = figures[("same", 1)]
    assert (row["selection_mode"], row["figure_page_number"], row["cross_page"], row["match_confidence"]) == ("same_page", 1, False, "local")
    assert (row["crop_x0"], row["crop_y0"], row["crop_x1"], row["crop_y1"]) == (12.0, 126.0, 588.0, 495.0)
    # raster 480 x 340 of 576 x 369, one image, height 369 of 800
    want = 480 * 340 / (576 * 369) * 8 + 0.75 + 369 / 800 * 1.6
    assert row["selection_score"] == pytest.approx(want, abs=1e-4)


def test_previous_page(figures):
    row = figures[("prev", 2)]
    assert (row["selection_mode"], row["figure_page_number"], row["caption_page_number"], row["cross_page"]) == ("previous_page", 1, 2, True)
    assert (row["crop_y0"], row["crop_y1"]) == (208.0, 788.0)


def test_detached_by_label(figures):
    assert [(figures[("labelled", n)]["figure_page_number"], figures[("labelled", n)]["match_confidence"]) for n in (1, 2)] == [(4, "explicit_label"), (2, "explicit_label")]
    assert figures[("labelled", 1)]["asset_mode"] == "original_pdf_detached_endmatter"


def test_detached_in_order_only_if_counts_agree(figures):
    assert [figures[("equal", n)]["figure_page_number"] for n in (1, 2)] == [2, 3]
    assert figures[("equal", 1)]["match_confidence"] == "sequential_exact"
    # three pages for two captions: nothing is paired, what is left is the region above the caption
    assert all(figures[("unequal", n)]["selection_mode"] == "same_page" for n in (1, 2) if ("unequal", n) in figures)


def test_table_pages_are_no_candidates(blocks):
    pages = layout.detached_pages(blocks, layout.best_captions(blocks)).where("doc_id = 'labelled'").collect()
    assert sorted((r["page_idx"], r["explicit_number"]) for r in pages) == [(1, 2), (3, 1)]


def test_image_guided_region(blocks):
    best = layout.best_captions_heuristic(blocks)
    row = layout.image_guided_regions(best, blocks).where("doc_id = 'same'").first()
    # lower of prose bottom + 8 and image top - 18; wide images do not widen the column
    assert (row["x0"], row["y0"], row["x1"], row["y1"]) == (14.0, 128.0, 586.0, 494.0)


def test_caption_anchor(blocks, spark):
    wanted = spark.createDataFrame([("same", 1), ("prev", 9)], "doc_id string, figure_no int")
    assert [r["caption"] for r in layout.caption_anchor(blocks, wanted).collect()] == [CAPTION.format(1)]


def test_units(spark):
    rows = [(0.1, 0.2, 0.5, 0.9, 600.0, 800.0, 100.0, 100.0), (10.0, 10.0, 50.0, 90.0, 600.0, 800.0, 100.0, 100.0), (100.0, 500.0, 900.0, 1000.0, 600.0, 800.0, 0.0, 0.0), (0.0, 0.0, 5000.0, 10.0, 600.0, 800.0, 100.0, 100.0)]
    df = spark.createDataFrame(rows, "x0 double, y0 double, x1 double, y1 double, page_w double, page_h double, src_w double, src_h double")
    got = [(r["unit"], r["x1"], r["y1"]) for r in layout.to_page_units(df).collect()]
    assert got == [("share", 300.0, 720.0), ("source", 300.0, 720.0), ("thousandth", 540.0, 800.0), (None, None, None)]


def test_joins_are_by_page(blocks):
    features = layout.block_features(blocks)
    plan = layout.crop_regions(layout.best_captions(features), features)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert features.where(F.col("prose")).count() > 0
