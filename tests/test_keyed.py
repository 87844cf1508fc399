"""Keyed tables and the archive: invariants."""

from pyspark.sql import functions as F

from corpuskit.operators import archive, identity, keyed
from corpuskit.plans import archive_fill


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_upsert_keeps_other_columns_and_is_idempotent(spark):
    target = spark.createDataFrame([(1, "a", 5, "t0"), (2, "b", 6, "t0")], "k int, name string, hits int, seen string")
    updates = spark.createDataFrame([(2, "B"), (3, None)], "k int, name string")
    once = keyed.upsert(target, updates, ["k"], defaults={"hits": F.lit(0)}, touch={"seen": F.lit("t1")})
    assert rows(once.na.fill("-")) == [(1, "a", 5, "t0"), (2, "B", 6, "t1"), (3, "-", 0, "t1")]
    twice = keyed.upsert(once, updates, ["k"], defaults={"hits": F.lit(0)}, touch={"seen": F.lit("t1")})
    assert rows(twice.na.fill("-")) == rows(once.na.fill("-"))
    assert once.schema == target.schema or [f.dataType for f in once.schema] == [f.dataType for f in target.schema]


def test_insert_if_absent(spark):
    target = spark.createDataFrame([("x", "curated")], "k string, v string")
    new = spark.createDataFrame([("x", "ai", 1), ("y", "late", 2), ("y", "early", 1)], "k string, v string, pos int")
    once = keyed.insert_if_absent(target, new, ["k"], ["pos"])
    assert rows(once) == [("x", "curated"), ("y", "early")]
    assert rows(keyed.insert_if_absent(once, new, ["k"], ["pos"])) == rows(once)


def test_plan_missing_respects_the_version(spark):
    cache = spark.createDataFrame([("p", "core", "v1"), ("p", "fig", "v2"), ("q", "core", "v2")], "key string, stage string, analysis_version string")
    papers = spark.createDataFrame([("p",), ("q",)], "key string")
    assert rows(keyed.plan_missing(papers, "key", ["core", "fig"], cache, "v2")) == [("p", "core"), ("q", "fig")]


def test_identity_cascade(spark):
    long_title = "A sufficiently long title of five words or more"
    files = [
        ("a", "x 10.1000/ABC). PMC12345", "t", "f.pdf"), ("b", "PMC1234567 PMID: 7654321", "", ""), ("c", "pmid 7654321", "", ""),
        ("d", "in 2020", long_title, ""), ("e", "no year", long_title, ""), ("f", "Supplementary Information 10.1000/ABC", "", ""), ("g", None, None, None),
        ("h", "Supplementary information", "", ""),
    ]
    df = spark.createDataFrame(files, "file_hash string, text string, title string, filename string")
    got = {r["file_hash"]: r for r in identity.resolve_identity(df, 2025).collect()}
    assert got["a"]["canonical_key"] == "doi:10.1000/abc" and got["a"]["confidence"] == "high"
    assert got["b"]["canonical_key"] == "pmcid:PMC1234567" and got["c"]["canonical_key"] == "pmid:7654321"
    assert got["d"]["canonical_key"].startswith("titleyear:2020:") and got["d"]["identity_value"] == f"{long_title} (2020)"
    assert got["e"]["canonical_key"] == "sha256:e" and got["e"]["confidence"] == "exact_file_only"
    assert got["f"]["canonical_key"] == "doi:10.1000/abc:supplement"
    assert got["g"]["canonical_key"] == "sha256:g" and got["g"]["title"] == ""
    # the file fallback never carries a suffix
    assert got["h"]["canonical_key"] == "sha256:h" and got["h"]["document_kind"] == "supplement"


def test_supplements_are_named_or_headed(spark):
    rows = [
        ("a", "x" * 60000 + " 10.1000/late", "", ""),
        ("b", "10.1000/own text that ends: see Supplementary Information for details", "", ""),
        ("c", "10.1000/own\n  S1. Supplementary Information:  \nTable", "", ""),
        ("d", "10.1000/own", "", "x_Supplementary_Material.pdf"),
        ("e", "10.1000/own", "Supporting information to a study", ""),
    ]
    df = spark.createDataFrame(rows, "file_hash string, text string, title string, filename string")
    got = {r["file_hash"]: (r["identity_type"], r["document_kind"]) for r in identity.resolve_identity(df, 2025).collect()}
    assert got == {"a": ("doi", "main"), "b": ("doi", "main"), "c": ("doi", "supplement"), "d": ("doi", "supplement"), "e": ("doi", "supplement")}


def test_rollup_reports_conflicts(spark):
    df = spark.createDataFrame([("k", "t1", 1, "h1"), ("k", "t2", 2, "h2"), ("j", "t", 3, "h3")], "canonical_key string, title string, seen int, h string")
    got = {r["canonical_key"]: r for r in identity.entity_rollup(df, "canonical_key", "seen", ["title"], "h").collect()}
    assert (got["k"]["title"], got["k"]["first_seen_at"], got["k"]["n_files"], got["k"]["has_conflict"]) == ("t2", 1, 2, True)
    assert got["j"]["has_conflict"] is False


CONCEPTS = "id string, canonical_name string, normalized_name string, difficulty string, quality_status string, hit_count bigint"
ALIASES = "concept_id string, alias_display string, alias_normalized string"


def _archive(spark):
    concepts = spark.createDataFrame([("1", "PCR", "pcr", "basic", "CURATED", 4), ("2", "ELISA", "elisa", "basic", "REVIEWED", 0)], CONCEPTS)
    aliases = spark.createDataFrame([("1", "polymerase chain reaction", "polymerase chain reaction"), ("2", "PCR", "pcr"), ("9", "gone", "gone")], ALIASES)
    return concepts, aliases


def test_parse_terms(spark):
    raw = spark.createDataFrame([(1, " PCR, pcr.;\nElisa\n,, ;Straße, \uff30CR"), (2, None), (3, "x" * 400 + "1," + "x" * 400 + "2")], "request_id int, raw string")
    want = [(1, "PCR", "pcr"), (1, "Elisa", "elisa"), (1, "Straße", "strasse"), (3, "x" * 400 + "1", "x" * 400 + "1"), (3, "x" * 400 + "2", "x" * 400 + "2")]
    got = archive.parse_terms(raw, "raw", "request_id").orderBy("request_id", "pos").collect()
    assert [(r["request_id"], r["term"], r["normalized"]) for r in got] == want


def test_lookup_splits_hits_and_misses(spark):
    concepts, aliases = _archive(spark)
    requests = spark.createDataFrame([(1, "pcr, Polymerase chain reaction, Western blot"), (2, "PCR; gone; WESTERN  blot")], "request_id int, raw string")
    hits, misses, counted = archive_fill.lookup(requests, concepts, aliases)
    assert {(r["normalized"], r["concept_id"], r["matched_by"]) for r in hits.collect()} == {("pcr", "1", "name"), ("polymerase chain reaction", "1", "alias")}
    # a dangling alias is a miss; the last spelling is kept
    assert {r["term"] for r in misses.collect()} == {"gone", "WESTERN blot"}
    assert {r["id"]: r["hit_count"] for r in counted.collect()} == {"1": 6, "2": 0}
    assert sum(r["n_terms"] for r in archive_fill.miss_batches(misses).collect()) == 2


def test_ingest_is_idempotent_and_keeps_curated_rows(spark):
    concepts, aliases = _archive(spark)
    explained = spark.createDataFrame(
        [("blot", "Western blot", ["WB", "PCR", "western  blot"], "intermediate", 1), ("p", "pcr", ["PCR test"], "advanced", 2), ("x", " ", ["y"], "basic", 3)],
        "requested_term string, canonical_name string, aliases array<string>, difficulty string, pos int",
    )
    c1, a1 = archive.ingest_explanations(concepts, aliases, explained, ["pos"])
    by_name = {r["normalized_name"]: r for r in c1.collect()}
    assert set(by_name) == {"pcr", "elisa", "western blot"} and by_name["pcr"]["quality_status"] == "CURATED"
    owners = {r["alias_normalized"]: r["concept_id"] for r in a1.collect()}
    assert owners["pcr"] == "2" and owners["wb"] == owners["blot"] == by_name["western blot"]["id"] and owners["pcr test"] == "1"
    c2, a2 = archive.ingest_explanations(c1, a1, explained, ["pos"])
    assert rows(c2) == rows(c1) and rows(a2) == rows(a1)
