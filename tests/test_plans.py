"""Sources and end-to-end plans."""

import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuskit.operators import records, search
from corpuskit.operators.ordered import bundle_by_length
from corpuskit.operators.requests import build_requests
from corpuskit.operators.taxonomy import facet_label, facet_title
from corpuskit.plans import browsing, reading
from corpuskit.session import shared_folder, staged
from corpuskit.sources import profiles as source
from corpuskit.sources import tables

PROFILES = [
    {
        "name": "Flow cytometry", "aliases": ["FACS"], "category": "cells",
        "papers": [
            {"pmcid": "PMC1", "title": "T cells", "figures": [{"figure": "Figure 2", "caption": "Gating by FACS. (A) cells (B-C) more"}, {"figure": "Fig. 3", "caption": "Blot"}]},
            {"pmcid": "PMC2", "title": "No figures", "figures": None},
        ],
    },
    {"name": "Western blot", "aliases": None, "category": None},
    {"name": "qPCR", "aliases": ["real-time PCR", "RT-qPCR"], "papers": []},
]


def load(spark, tmp_path):
    path = tmp_path / "profiles.json"
    path.write_text(json.dumps(PROFILES), encoding="utf-8")
    return source.load_profiles(spark, str(path), multi_line=True)


def test_missing_corpus_is_empty(spark, tmp_path):
    assert source.load_profiles(spark, str(tmp_path / "none.json")).count() == 0
    assert source.load_image_index(spark, str(tmp_path / "none.json")).count() == 0


def test_flattened_corpus(spark, tmp_path):
    profiles = load(spark, tmp_path)
    terms = {(r["alias"], r["canonical"]) for r in source.method_terms(profiles).collect()}
    assert terms == {("Flow cytometry", "Flow cytometry"), ("FACS", "Flow cytometry"), ("Western blot", "Western blot"), ("qPCR", "qPCR"), ("real-time PCR", "qPCR"), ("RT-qPCR", "qPCR")}
    assert source.method_papers(profiles).count() == 2 and source.method_figures(profiles).count() == 2


def test_image_index(spark, tmp_path):
    path = tmp_path / "images.json"
    path.write_text(json.dumps({"PMC1": {"Figure 2": {"href": "f2.jpg"}, "Fig. 3": {"href": ""}}}), encoding="utf-8")
    index = source.load_image_index(spark, str(path))
    assert [tuple(r) for r in index.collect()] == [("PMC1", "Figure 2", "f2.jpg")]
    figures = browsing.with_images(source.method_figures(load(spark, tmp_path)), index)
    best = search.representative_figure(figures.select("name", "has_image", "paper_pos", "figure_pos", "figure"), ["name"]).collect()
    assert [(r["name"], r["figure"]) for r in best] == [("Flow cytometry", "Figure 2")]


def test_browse_search_and_panels(spark, tmp_path):
    profiles = load(spark, tmp_path)
    stored = spark.createDataFrame(
        [("qpcr", 2, {"material": ["protein"], "purpose": []}), ("western blot", 1, {"material": ["cell"]})],
        "normalized_name string, taxonomy_version int, facets map<string, array<string>>",
    )
    counts, found = browsing.browse(profiles, stored, {"material": ["protein"], "purpose": []})
    assert {r["name"] for r in found.collect()} == {"qPCR", "Western blot"}
    by = {(r["facet"], r["value"]): r["n_methods"] for r in counts.collect()}
    assert by[("purpose", "detect_quantify")] == 2 and by[("detection", "fluorescence")] == 3
    hits = [(r["query"], r["name"], r["tier"]) for r in browsing.search(profiles, ["facs", "real time", "q"]).orderBy("query", "rank").collect()]
    assert ("facs", "Flow cytometry", 1) in hits and ("real time", "qPCR", 3) in hits and ("q", "qPCR", 2) in hits
    panels = {r["figure"]: r for r in browsing.panel_map(profiles).collect()}
    assert panels["Figure 2"]["header"] == "Fig. 2A-C" and panels["Figure 2"]["usages"][0]["status"] == "figure_context"
    assert panels["Fig. 3"]["mode"] == "linked_only" and panels["Fig. 3"]["header"] == "Fig. 3"


def test_labels(one):
    assert one(lambda c: facet_label(F.lit("material"), c, "ko"), "protein") == "단백질"
    assert one(lambda c: facet_label(F.lit("material"), c), "unknown") == "unknown"
    assert one(lambda c: facet_title(c, "en"), "labeling") == "Labeling"


def test_scoped_search(spark, tmp_path):
    papers = source.method_papers(load(spark, tmp_path))
    count = lambda *a, **k: search.scoped_search(papers, *a, **k).count()
    assert (count(""), count("t CELLS", "title"), count("gating", "title"), count("gating", "caption"), count("blot"), count("", figures_only=True)) == (2, 1, 0, 1, 1, 1)


def test_reading_plan(spark):
    text = "We used flow cytometry, flow cytometry and PCR. doi 10.1000/a"
    files = spark.createDataFrame([("h1", "a.pdf", "", text, 1), ("h2", "b.pdf", "", text + " ", 2), ("h3", "c.pdf", "", "PCR only", 3)], "file_hash string, filename string, title string, text string, seen int")
    entities, aliases = reading.register_files(files, 2025)
    assert {r["canonical_key"]: r["n_files"] for r in entities.collect()} == {"doi:10.1000/a": 2, "sha256:h3": 1}
    cache = spark.createDataFrame([("doi:10.1000/a", "undergraduate", "core", "v2", "{}", "m", 7, 0)], "canonical_key string, depth string, stage string, analysis_version string, result_json string, model string, hit_count bigint, updated_at int")
    terms = spark.createDataFrame([("flow cytometry", "FC"), ("pcr", "PCR")], "alias string, canonical string")
    requests = reading.missing_requests(files, aliases, cache, terms, {"core": "Read.", "figures": "Look."}, "v2").collect()
    assert {(r["canonical_key"], r["stage"]) for r in requests} == {("doi:10.1000/a", "figures"), ("sha256:h3", "core"), ("sha256:h3", "figures")}
    assert next(r for r in requests if r["canonical_key"].startswith("doi"))["prompt"].startswith("Look.\n\nPOSSIBLE METHODS\nFC, PCR\n\nPAPER TEXT\nWe used")
    schema = T.StructType([T.StructField("takeaway", T.StringType(), False)])
    answers = spark.createDataFrame([("sha256:h3", "undergraduate", "core", '{"takeaway": "x"}', "m2", 9), ("sha256:h3", "undergraduate", "figures", "oops", "m2", 9)], "canonical_key string, depth string, stage string, response_json string, model string, updated_at int")
    state, bad = reading.store_responses(cache, answers, schema, "v2")
    assert {(r["canonical_key"], r["stage"], r["hit_count"]) for r in state.collect()} == {("doi:10.1000/a", "core", 7), ("sha256:h3", "core", 0)}
    assert [r["stage"] for r in bad.collect()] == ["figures"]


def test_states_are_never_overwritten(spark, tmp_path):
    df = spark.createDataFrame([(1,)], "k int")
    tables.write_state(df, str(tmp_path / "s"))
    try:
        tables.write_state(df, str(tmp_path / "s"))
        raise AssertionError("second write went through")
    except Exception as error:  # noqa: BLE001
        assert "already exists" in str(error).lower() or "PATH_ALREADY_EXISTS" in str(error)
    assert staged(df, "test").count() == 1


def test_quarantine(spark):
    concepts = spark.createDataFrame([("a", "basic", "CURATED", ["x"], 0), ("", "hard", "CURATED", None, -1)], "canonical_name string, difficulty string, quality_status string, prerequisites array<string>, hit_count int")
    good, bad = records.quarantine(records.validate(concepts, records.concept_rules()))
    assert good.count() == 1 and bad.first()["errors"] == ["name", "difficulty", "prerequisites", "hit_count"]


def test_shared_folder_follows_the_cluster_setting():
    class Session:
        def __init__(self, **settings):
            self.conf = settings

    cluster = {"spark.master": "spark://host:7077"}
    assert shared_folder(Session(**cluster, **{"spark.checkpoint.dir": "hdfs:/x/"}), "a").startswith("hdfs:/x/corpuskit/a-")
    local = {"spark.master": "local[8]"}
    first, second = (shared_folder(Session(**local), "a") for _ in range(2))
    assert first != second and first.rsplit("/", 2)[0] == second.rsplit("/", 2)[0]
    for master in ("spark://host:7077", "yarn", "local-cluster[3,2,1024]", ""):
        with pytest.raises(ValueError):
            shared_folder(Session(**{"spark.master": master}), "a")


def test_long_texts_become_several_requests(spark):
    text = "0123456789" * 30
    papers = spark.createDataFrame([("k", text, "core " * 20_000, ["m"] * 40)], "key string, text string, core string, hints array<string>")
    rows = build_requests(papers, "core", "key", "Read.", text_chars=128, core="core", hints="hints").orderBy("part").collect()
    assert [(r["part"], r["n_parts"]) for r in rows] == [(0, 3), (1, 3), (2, 3)]
    assert "".join(r["prompt"].split("PAPER TEXT\n")[1] for r in rows) == text
    assert all(r["prompt"].count("core ") == 20_000 and r["prompt"].count("m, ") == 39 for r in rows)


def test_bundles_keep_the_text(spark):
    texts = ["a" * 25, "", "b" * 3, "c" * 9, "d" * 40]
    df = spark.createDataFrame([("k", i, t) for i, t in enumerate(texts)], "k string, i int, t string")
    rows = bundle_by_length(df, ["k"], ["i"], F.col("i"), "t", 10).orderBy("i", "bundle").collect()
    back = {}
    for r in rows:
        back[r["i"]] = back.get(r["i"], "") + r["t"]
    assert [back[i] for i in range(5)] == texts
    sizes = {}
    for r in rows:
        sizes[r["bundle"]] = sizes.get(r["bundle"], 0) + len(r["t"])
    assert max(sizes.values()) <= 10
