"""SQL that states a rule states it for inputs beyond the test tables, too."""

import pytest
from check_queries import TABLES, compare, connect

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def agrees(spark, tmp_path_factory):
    """Compare a query with its SQL where one table holds the given rows and the others are the smallest test tables."""

    def run(query, name, rows, schema):
        folder = tmp_path_factory.mktemp("odd")
        for t in TABLES:
            if t != name:
                (folder / f"{t}.parquet").symlink_to(f"{FOLDER}/{t}.parquet")
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
        con = connect(FOLDER)
        con.execute(f"CREATE OR REPLACE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet/*.parquet')")
        return compare(entry.queries()[query](spark, str(folder)), con, entry.oracle_sql()[query])

    return run


def test_clean_pages_decodes_every_reference(agrees):
    from html.entities import html5

    odd = [
        "a &amp b &am c &AMP;lt; &amp;amp; &ampx &notit; &notin; &nosuch; & &; &&amp;&", "&#65;&#x42;&#X43 &#0; &#13; &#128;&#x81;&#xd800;&#x110000;&#99999999999999999999; &#1;&#xFFFE; &#;&#x;",
        "x&nbsp;　y \x0b z- \n\xa0w \x00 \x1c", None, "", "&" + "n" * 40 + ";", "&acE;&fjlig;&NotEqualTilde;", "&\t&\f&<&#&frac12x&frac1",
        "&lt-\n &shy;&zwj;", " ".join(f"&{n}|" for n in html5),
    ]
    assert agrees("clean_pages", "pages", [(i, "u", h) for i, h in enumerate(odd)], "page_id long, url string, html string") is None


def test_mention_join_folds_terms_as_texts(agrees):
    rows = [(0, "Große Straße"), (1, "STRAẞE eins"), (2, "plain")]
    assert agrees("mention_join", "benchmark", rows, "item_id long, text string") is None


def test_resolve_identity_takes_years_from_everywhere(agrees):
    texts = ["In 1987 it was", "", "x 2150 y2001 2026.", "doi:10.5555/AB(1)).", "PMC1234567 and pmid 7654321", "Text 1950"]
    rows = [(6 * b + k, t, "en", "src1", len(t)) for b in (0, 317, 331, 340) for k, t in enumerate(texts)]
    assert agrees("resolve_identity", "documents", rows, "doc_id long, text string, lang string, source string, n_chars long") is None


def test_resolve_identity_finds_supplements_anywhere(agrees):
    texts = ["x", " Supporting Information for all", "a\n S3: Supplemental material. \nb", "the supporting information", "Supplementary Materials", "SUPPORTING MATERIALS"]
    rows = [(6 * b + k, t, "en", "src1", len(t)) for b in (1, 2) for k, t in enumerate(texts[b:] + texts[:b])]
    assert agrees("resolve_identity", "documents", rows, "doc_id long, text string, lang string, source string, n_chars long") is None


def test_compact_docs_cuts_and_strips_every_text(agrees):
    odd = [
        "", None, " \n\t ", "a", "　\x0b\n", "\xa0edges  and \x1c\x85", "one\n\n\n", "\n\nReferences", "x " * 700 + "\nBIBLIOGRAPHY\n1. y\nReferences\n2. z", "short\nreferences\n" + "late " * 400,
        "body " * 30 + "\n \x0b\n \n\xa0References　\n1. First", "references\n" * 40, "\n" * 30 + "Referenceſ\nreferences x\nreferences", "ß가 \U0001f600" * 500 + "\r\nreferences\r\n1", "﻿​", "a" * 1999 + "\n\n\nend",
    ]
    rows = [(i, t, "en", s, 0) for i, t in enumerate(odd * 3) for s in (["src1", None, "s \n"][i // len(odd)],)]
    assert agrees("compact_docs", "documents", rows, "doc_id long, text string, lang string, source string, n_chars long") is None


def test_flatten_middle_takes_empty_captions(agrees):
    odd = ["", None, " \n\t ", "a", "\x0b", "v\x0btab\x0b\x0b x\x0c", "\xa0 edges　\n", "line\n" * 100, "\n" * 75, "(A-H), (D) and E, f) g"]
    rows = [(i, t, "en", "src1", 0) for i, t in enumerate(odd)]
    assert agrees("flatten_middle", "documents", rows, "doc_id long, text string, lang string, source string, n_chars long") is None
