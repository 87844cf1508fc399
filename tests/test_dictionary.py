"""Dictionary operators against plain Python."""

import random
import re

import pytest
from pyspark.sql import functions as F

from corpuskit.functions.notes import annotate_texts
from corpuskit.functions.python_udfs import protect_terms_udf, restore_terms
from corpuskit.operators import dictionary, linking

TERMS = [
    ("PCR", "PCR"), ("qPCR", "qPCR"), ("RT-PCR", "PCR"), ("pcr", "PCR"), ("flow cytometry", "FC"), ("C++", "CPP"), ("-seq", "SEQ"),
    ("für", "DE"), ("가나", "KO"), ("(a)", "A"), ("IL-6", "IL"), ("++", "PLUS"), (" α", "ALPHA"), (" +", "BLANK"), ("a a", "AA"), (" x", "X"),
]
TEXTS = [
    "PCR pcr qPCR RT-PCR xPCR PCR2 PCR-PCR", "flow cytometry Flow  cytometry, FLOW CYTOMETRY.", "C++ c++x C++; ++ +++", "RNA-seq ATAC-seq -seq x-seqs",
    "für FÜR dafür fürür", "가나 가나다 x가나", "(a) (A) b(a)c", "IL-6IL-6 IL-6, IL-60", "", "nothing", "TGF-β, α and γ", "x, + y +", "a a a a b", "an x and x",
]


def expected():
    out = {}
    for i, text in enumerate(TEXTS):
        for alias, canonical in TERMS:
            pattern = r"(?<![A-Za-z0-9])" + re.escape(alias) + r"(?![A-Za-z0-9])"
            n = len(re.findall(pattern, text, re.IGNORECASE))
            if n:
                out[(i, canonical)] = out.get((i, canonical), 0) + n
    return out


@pytest.mark.parametrize("broadcast", ["-1", "10m"])
def test_term_counts(spark, broadcast):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id int, text string")
    counts = dictionary.term_counts(docs, spark.createDataFrame(TERMS, "alias string, canonical string"))
    assert {(r["doc_id"], r["canonical"]): r["hits"] for r in counts.collect()} == expected()
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_mention_pairs_by_brute_force(spark):
    """Terms with blanks at their ends, inside, or nothing else; texts with runs of blanks."""
    rnd = random.Random(5)
    some = lambda n: "".join(rnd.choice("ab  c") for _ in range(n))
    texts = [(i, some(rnd.randint(0, 14))) for i in range(300)] + [(900, None), (901, ""), (902, "abcabc"), (903, "x" * 50_000 + " y")]
    terms = list({some(rnd.randint(0, 5)) for _ in range(150)}) + [" ", "  ", "x" * 300, "xx y", None]
    pairs = dictionary.mention_pairs(spark.createDataFrame(texts, "id int, t string"), spark.createDataFrame([(t,) for t in terms], "term string"), "id", "t", "term")
    want = {(i, s) for i, t in texts if t is not None for s in terms if s and s in t}
    assert len(want) > 1000 and sorted((r["id"], r["term"]) for r in pairs.distinct().collect()) == sorted(want)


def test_mention_pairs(spark):
    texts, terms = ["flow cytometry of cells", "if", "stiff", "x", "", "가나다 x\nif"], ["if", "flow", "x", "가나", "cells", "flow cytometry of cells", "q"]
    pairs = dictionary.mention_pairs(
        spark.createDataFrame(list(enumerate(texts)), "id int, t string"), spark.createDataFrame([(t,) for t in terms], "term string"), "id", "t", "term"
    )
    want = {(i, t) for i, x in enumerate(texts) for t in terms if t in x}
    got = [tuple(r) for r in pairs.select("id", "term").collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_seed_glossary_longest_first(spark):
    docs = spark.createDataFrame([("RT-qPCR and qPCR with facs",), ("nothing",)], "text string")
    rows = [[g["surface"] for g in r["glossary"]] for r in dictionary.seed_glossary(docs, "text").collect()]
    assert rows == [["RT-qPCR", "FACS", "qPCR", "PCR"], []]


def test_protect_and_restore(spark):
    texts = ["STAT3 binds IL-6 in pSTAT5 cells; flow cytometry 12 of 3", "", "PCR " * 300, "marks \ue000\ue010\ue001 inside", "a b"]
    protect = protect_terms_udf(["flow cytometry", "12", "cells", "IL-6"])
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", protect("t").alias("p")).select("t", "p.*", restore_terms("p.text", "p.terms").alias("back")).collect()
    assert [r["back"] for r in rows] == texts
    assert {t["original"] for t in rows[0]["terms"]} == {"STAT3", "IL-6", "pSTAT5", "flow cytometry", "12", "cells"}
    assert len(rows[2]["terms"]) == 300
    spaced = spark.createDataFrame([("\ue000 \ue010 \ue001 x", [("\ue000\ue010\ue001", "PCR")])], "t string, m array<struct<token: string, original: string>>")
    assert spaced.select(restore_terms("t", "m").alias("r")).first()["r"] == "PCR x"


def test_annotation(spark):
    glossary = [("PCR", "PCR", "가"), ("qPCR", "qPCR", "나"), ("ELISA", "ELISA", "다")]
    texts = ["use qPCR now", "(PCR) then PCR", "https://PCR.org", "ELISA (다) and ELISA", "PCR again"]
    df = spark.createDataFrame([(texts, glossary)], "t array<string>, g array<struct<surface: string, english: string, local_form: string>>")
    # the text behind a longer term counts as annotated for the shorter one
    assert df.select(annotate_texts(F.col("t"), F.col("g")).alias("a")).first()["a"] == ["use qPCR (나) now", "(PCR) then PCR", "https://PCR.org", "ELISA (다) and ELISA", "PCR again"]


def slow_notes(texts, glossary):
    """What annotating means, spelled out character by character."""
    done, out = set(), []
    for text in texts:
        for surface, english, local in sorted(glossary, key=lambda g: -len(g[0])):
            if text.startswith("http") or english.lower() in done:
                continue
            depth = [False] * (len(text) + 1)
            for i, c in enumerate(text):
                depth[i + 1] = c == "(" or (depth[i] and c != ")")
            hits = [i for i in range(len(text)) if text[i : i + len(surface)].lower() == surface.lower() and not depth[i]]
            if hits:
                i, j = hits[0], hits[0] + len(surface)
                if not re.match(r"\s*\([^)]*[가-힣][^)]*\)", text[j:]):
                    text = f"{text[:j]} ({local}){text[j:]}"
                done.add(english.lower())
        out.append(text)
    return out


def test_annotation_equals_brute_force(spark):
    import random

    rng = random.Random(4)
    glossary = [("pcr", "PCR", "가"), ("qPCR", "qPCR", "나"), ("b", "B", "다"), ("xb", "b", "라")]
    cases = [["".join(rng.choice(["pcr", "qPCR", "PCR", " ", "(", ")", "b", "x", "가", "https://b"]) for _ in range(rng.randint(0, 9))) for _ in range(3)] for _ in range(200)]
    df = spark.createDataFrame([(t, glossary) for t in cases], "t array<string>, g array<struct<surface: string, english: string, local_form: string>>")
    for row in df.select("t", annotate_texts(F.col("t"), F.col("g")).alias("a")).collect():
        assert row["a"] == slow_notes(row["t"], glossary), row["t"]


def test_fuzzy_links_equal_brute_force(spark):
    import difflib
    import random

    rng = random.Random(3)
    aliases = ["flow cytometry", "mass cytometry", "western blot", "western blotting", "elisa", "pcr", "qpcr", "rt pcr", "confocal microscopy", "abcd", "aaaa", "aaab"]
    names = {"flow cytometri", "westrn blot", "elissa", "pc", "rtpcr", "mas cytometry", "zzzz", "aaba", "abab"}
    for a in aliases:
        for _ in range(12):
            chars = list(a)
            for _ in range(rng.randint(1, 3)):
                chars[rng.randrange(len(chars))] = rng.choice("abcdefghij lmnoprstuwy")
            names.add("".join(chars).strip() or "x")
    dictionary_df = spark.createDataFrame([(a, a.upper(), i) for i, a in enumerate(aliases)], "alias string, canonical string, pos long")
    got = {r["name"]: r["canonical"] for r in linking.fuzzy_links(spark.createDataFrame([(n,) for n in names], "name string"), dictionary_df).collect()}
    want = {}
    for n in names:
        scores = [(difflib.SequenceMatcher(None, n, a).ratio(), -i) for i, a in enumerate(aliases)]
        best, pos = max(scores)
        if best >= 0.82:
            want[n] = aliases[-pos].upper()
    assert got == want


def test_link_tiers(spark):
    d = spark.createDataFrame([("pcr", "PCR", 0), ("pcr", "PCR2", 1), ("flow cytometry", "FC", 2), ("cytometry", "C", 3)], "alias string, canonical string, pos long")
    names = spark.createDataFrame([("pcr",), ("flow",), ("the flow cytometry kit",), ("flwo cytometrie",), ("zzz",), ("",)], "name string")
    links = {r["name"]: (r["canonical"], r["tier"]) for r in linking.entity_links(names, d).collect()}
    assert links == {
        "pcr": ("PCR2", "exact"), "flow": ("FC", "contains"), "the flow cytometry kit": ("FC", "contains"), "flwo cytometrie": ("FC", "fuzzy"),
    }


def test_literal_mentions(one):
    assert one(lambda c: dictionary.mentions_of(c, ["if", "pcr", "x"]), "stiff pcr") == ["if", "pcr"]
