"""Scalar functions at their edges."""

import pytest
from pyspark.sql import functions as F

from corpuskit.functions import labels as L
from corpuskit.functions import sentences as S
from corpuskit.functions import text as X


def test_concepts(one):
    assert one(X.normalize_concept, ' "Flow  Cytometry". ') == "flow cytometry"
    assert one(X.normalize_concept, None) == ""
    assert one(X.normalize_concept, "ＦＩＣ Straße") == "fic strasse"
    assert one(lambda c: X.normalize_concept(c), "Identi\ufb01cation of \uff24\uff2e\uff21") == "identification of dna"
    assert len(one(X.clean_concept, "x " * 200)) == 399
    assert one(X.single_term, " a,  b;\nc ") == "a, b; c"


def test_names_and_titles(one):
    assert one(X.normalize_method_name, " RT_-/qPCR  Assay") == "rt qpcr assay"
    assert one(X.normalize_match_text, "IL-6 (p<0.05) – 단백질") == "il 6 p 0 05 단백질"
    assert one(X.normalize_title, "A — New: Title") == "a new title"
    assert one(X.clean_text, "x &amp; y\x00z hyphen-\n ated") == "x & y z hyphenated"


@pytest.mark.parametrize(
    "raw, doi",
    [
        ("https://doi.org/10.1/AbC.", "10.1/abc"),
        ("doi: 10.1/a(b))", "10.1/a(b)"),
        ("10.1/a(b)", "10.1/a(b)"),
        ("10.1/x])", "10.1/x"),
        ("10.1/a)b))", "10.1/a)b"),
        ("", ""),
    ],
)
def test_clean_doi(one, raw, doi):
    assert one(X.clean_doi, raw) == doi


def test_cutters(one):
    assert one(lambda c: X.concise_text(c, 12), "alpha beta gamma") == "alpha beta…"
    assert one(lambda c: X.concise_text(c, 12), "short") == "short"
    assert one(lambda c: X.keyword_snippet(c, "zz"), "abc") == "abc"
    text = "y" * 400 + "KEY" + "z" * 600
    assert one(lambda c: X.keyword_snippet(c, "key"), text) == text[150 : 400 + 3 + 450]
    body = "line\n" * 40
    assert one(X.compact_text, body + "\n  References \nfoo") == body
    assert one(X.compact_text, "References\n" + body).startswith("References")
    assert one(lambda c: X.compact_text(c, 100), "a" * 70 + "b" * 100) == "a" * 68 + X.COMPACT_MARKER + "b" * 32
    assert one(lambda c: X.omitted_chars(c, 100), "a" * 170) == 70
    assert one(X.compact_text, "a" * 400_000) == "a" * 400_000
    assert one(lambda c: X.text_slices(c, 4), "abcdefghij") == ["abcd", "efgh", "ij"] and one(lambda c: X.text_slices(c, 4), None) == [""]


def test_predicates(one):
    prose = "This sentence has many plain words, and it goes on for quite a while. " * 2
    assert one(X.is_prose, prose) and one(X.is_body_prose, prose) and one(X.is_loose_prose, prose)
    assert not one(X.is_prose, "Figure 1. " + prose)
    assert not one(X.is_prose, "1 2 3 4 5 6 7, 8, 9 10 11 12 13 14 15 16 17 18 19 20 21.")
    assert one(X.mostly_korean, "") is True
    assert one(X.mostly_korean, "123") is False
    assert one(X.mostly_korean, "단백질 ab") is True
    assert one(X.is_error_page, " Error 500 ") and one(X.is_error_page, "") and not one(X.is_error_page, "fine")
    assert one(lambda c: X.inside_parentheses(c, F.lit(6)), "a (b) (c)") is False
    assert one(lambda c: X.inside_parentheses(c, F.lit(7)), "a (b) (c)") is True
    assert one(lambda c: X.followed_by_hangul_note(c, F.lit(3)), "PCR (가)") is True
    assert one(lambda c: X.followed_by_hangul_note(c, F.lit(3)), "PCR (" + "x" * 500 + "가)") is True


def test_numbers(one):
    assert one(lambda c: X.safe_int(c, 7), "2,500,000 ") == 2500000
    assert one(lambda c: X.safe_int(c, 7), "x") == 7
    assert one(lambda c: X.safe_int(c, 7), None) == 7
    assert one(lambda c: X.bounded_int(c, 5, 1, 9), "99") == 9


@pytest.mark.parametrize(
    "raw, labels",
    [("A", "A"), ("A-C", "ABC"), ("A–C", "ABC"), ("A to C", "ABC"), ("A and B", "AB"), ("A, C-E", "ACDE"), ("A & A", "A"), ("C-A", ""), ("", "")],
)
def test_panel_labels(one, raw, labels):
    assert "".join(one(L.expand_panel_labels, raw)) == labels


@pytest.mark.parametrize("labels, text", [("ABC", "A-C"), ("ACF", "A,C,F"), ("A", "A"), ("", ""), ("BA", "B,A")])
def test_compact_range(one, labels, text):
    assert one(lambda c: L.compact_panel_range(F.filter(F.split(c, ""), lambda x: x != "")), labels) == text


def test_expand_and_compact_round_trip(one):
    for raw in ("A-C", "B-F", "D"):
        assert one(lambda c: L.compact_panel_range(L.expand_panel_labels(c)), raw) == raw


def test_label_preview(one):
    split = lambda c: F.split(c, ",")
    assert one(lambda c: L.label_preview(split(c)), "a,b,c,d,e,f,g") == "a, b, c, d, e +2 more"
    assert one(lambda c: L.label_preview(split(c), "ko"), "a,b,c,d,e,f") == "a, b, c, d, e 외 1개"


def test_points(one):
    assert one(S.sentence_points, "One. Two! Three? Four. Five.") == ["One.", "Two!", "Three?", "Four.", "Five."]
    assert one(lambda c: S.sentence_points(c, 2), "One. Two! Three?") == ["One.", "Two!"]
    long_clause = "first part of a very long sentence without any stop, then a second part, and finally the third"
    assert len(one(S.sentence_points, long_clause)) == 3
    assert one(S.split_points, "- one\n• two\n\n- three") == ["one", "two", "three"]
    assert one(S.sentence_points, " ") == []


@pytest.mark.parametrize("limit", [1, 7, 10, 25, 60])
@pytest.mark.parametrize("text", ["", "abc", "x" * 20, "x" * 25, "One two. Three four five! " + "y" * 50 + " z. End.", "a. b. c. d. e. f. g. h."])
def test_chunks_keep_the_text(one, text, limit):
    chunks = one(lambda c: S.chunk_text(c, limit), text)
    assert all(0 < len(c) <= limit for c in chunks)
    assert "".join(chunks).replace(" ", "") == text.replace(" ", "")


def test_collect_text(one):
    make = lambda c: S.collect_text(F.split(c, ","), 9)
    assert one(make, "abcd,x,https://e.org,efgh,ij") == "abcd\nefgh"
    assert one(make, "abcdefghijkl,mn") == "abcdefghi"
    assert one(lambda c: S.collect_text(F.split(c, ",")), "ab," + "x" * 30_000) == "ab\n" + "x" * 30_000
