"""The second engine sees only the documents that the first one left."""

from pyspark.sql import functions as F

from corpuskit.operators import layout
from corpuskit.plans import catalog_layout
from corpuskit.session import staged

FOLDER = "/root/testdata/sf0.001"


def test_only_uncovered_documents_go_to_the_second_engine(spark, monkeypatch):
    blocks = staged(catalog_layout._layout(spark, FOLDER), "blocks")
    some = blocks.where(F.crc32("doc_id") % 3 != 0)
    seen, real = [], layout.image_guided_figures
    monkeypatch.setattr(layout, "image_guided_figures", lambda b: seen.append(b) or real(b))
    found = layout.preferred_figures(some, blocks)
    first = {r["doc_id"] for r in found.where("engine = 'primary'").select("doc_id").distinct().collect()}
    given = {r["doc_id"] for r in seen[0].select("doc_id").distinct().collect()}
    everyone = {r["doc_id"] for r in blocks.select("doc_id").distinct().collect()}
    assert first and given == everyone - first
    second = {tuple(r) for r in found.where("engine = 'fallback'").drop("engine").collect()}
    assert second == {tuple(r) for r in real(blocks).collect() if r["doc_id"] not in first}
