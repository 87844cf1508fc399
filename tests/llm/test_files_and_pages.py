import os
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from corpuskit.llm import html_extract, labelled_pages, token_files

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_words_give_the_ids_of_whole_texts():
    plain, cached = Tokenizer.from_file(PATH), token_files.WordIds(PATH, 1)
    assert cached.by_word
    rng = random.Random(1)
    texts = ["", " ", "<|endoftext|>", "a<|endoftext|>b <|ENDOFTEXT|> x<|startoftext|>", "It's we'll 'S don't'", "Étude é Å İstanbul ΣΑΣ ΟΔΟΣ.", "a\u0085b\x1cc", "漢字 123abc45", "K Å ß ẞ ﬁne", "<|endoftext|>,<|endoftext|>."]
    texts += ["".join(rng.choice("abAB'slLtT .,|<>\n\t0é́ßΣσ ") for _ in range(rng.randint(0, 30))) for _ in range(2000)]
    for text in texts:
        assert cached.encode(text.encode()) == np.array(plain.encode(text, add_special_tokens=False).ids, dtype="<u2").tobytes(), repr(text)


@pytest.mark.parametrize("per_part", [3, 8192])
def test_files_round_trip(spark, documents, tmp_path, per_part):
    folder = f"file://{tmp_path}/set"
    assert token_files.write_tokens(documents, PATH, folder=folder, docs_per_part=per_part) == folder
    plain = Tokenizer.from_file(PATH)
    rows = sorted(documents.collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0))
    start, want = 0, []
    for r in rows:
        ids = [*plain.encode(r["text"] or "", add_special_tokens=False).ids, 1]
        want.append((r["doc_id"], start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        start += len(ids)
    got = sorted((tuple(r) for r in token_files.read_tokens(spark, folder).collect()), key=lambda r: r[1])
    assert got == want
    names = os.listdir(tmp_path / "set")
    assert sum(os.path.getsize(tmp_path / "set" / n) for n in names if n.endswith(".bin")) == 2 * start


def test_files_of_an_empty_table(spark, nothing, tmp_path):
    folder = token_files.write_tokens(nothing, PATH, folder=f"file://{tmp_path}/none")
    assert token_files.read_tokens(spark, folder).count() == 0


@pytest.fixture(scope="module")
def model(spark):
    return html_extract.fit(spark.createDataFrame([(p,) for p in labelled_pages.PAGES], "html string"))


def test_marginals_match_enumeration(model):
    tree = html_extract.parse('<body><nav><a href="/">x</a></nav><div class="post"><p>Some words of text here.</p></div><footer>bye</footer></body>')
    names, n = html_extract.features(tree), len(tree.tag)
    assert n == 6
    total, sums = 0.0, np.zeros((n, 3))
    for code in range(3**n):
        y = [code // 3**i % 3 for i in range(n)]
        p = (1.0, 0.01, 1.0)[y[0]]
        for i in range(1, n):
            p *= model.move[y[tree.parent[i]]][y[i]]
            for name in names[i]:
                p *= model.emit.get(name, model.emit[f"{name.split()[0]} "])[y[i]]
        total += p
        for i in range(n):
            sums[i, y[i]] += p
    assert np.allclose(model.marginals(tree), sums / total)


def test_main_text(model):
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/">Home page</a></li></ul></nav>
    <!-- <p>hidden</p> --><div class="ad">Buy this now</div><article><h1>A &amp; B</h1><p>First&nbsp;line <b>bold
    text</b> ends<br>here. It goes on for a while, as paragraphs do.<p>Second one &lt;tag&gt; &#233;.</p><ul><li>One item</li></ul></article><section class="comments"><p>I disagree with all of this.</p></section>
    <footer>&copy; me, all rights reserved</footer></body></html>"""
    assert model.extract(page) == "A & B\n\nFirst line bold text ends here. It goes on for a while, as paragraphs do.\n\nSecond one <tag> é.\n\nOne item"


def test_odd_pages(spark, model):
    deep = "<div>" * 3000 + "<article><p>" + "Deep text, a whole line of it. " * 5 + "</p></article>"
    pages = [None, "", "<", "<p", "a < b", "<a title='x", "<article><p class=\"un>closed", "</div></p>", deep, "<p>" * 500, "<script>never closed", "<article>" + "word " * 50_000 + "</article>"]
    frame = spark.createDataFrame([(i, "u", p, "old", 7) for i, p in enumerate(pages)] * 2, "page_id long, url string, html string, text string, h_text int")
    rows = html_extract.extract_pages(frame, model).collect()
    assert len(rows) == 2 * len(pages) and all(r["n_chars"] == len(r["text"]) for r in rows)
    got = {r["page_id"]: r["text"] for r in rows}
    assert got[0] == got[1] == "" and got[8].startswith("Deep text") and len(got[11]) == 50_000 * 5 - 1
    assert html_extract.extract_pages(frame.limit(0), model).count() == 0


def test_given_pages(spark, model):
    """On the given pages the article element holds the main text and nothing else does."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    outside = pages.select("page_id", "url", F.concat(F.regexp_extract("html", r"(?s)<article>.*</article>", 0)).alias("html"))
    want = {r["page_id"]: r["text"] for r in html_extract.extract_pages(outside, model).collect()}
    got = {r["page_id"]: r["text"] for r in html_extract.extract_pages(pages, model).collect()}
    assert got == want and all(got.values())


def test_word_ids_equal_the_tokenizer_on_odd_strings():
    """Combining marks behind capitals and punctuation, special tokens, letters whose case changes their length, other scripts, blanks of all kinds."""
    words = token_files.WordIds(public_tokenizers.path("word_bpe_49k.json"), 1)
    rnd = random.Random(7)
    marks = [chr(c) for c in range(0x300, 0x345)]
    plain = [*"abcXYZWTHJKIéÉßÀÿÑñİıſΣσςΩÅK019!.,'\"-|<>&#", " ", "\t", "\n", " ", " ", "<|endoftext|>", "<|startoftext|>", "한", "漢", "☃"]
    for text in ["Y̊", "W̊ T̈ H̱ J̌"]:
        assert np.frombuffer(words.encode(text.encode()), dtype=words.dtype).tolist() == words.whole(text)
    for _ in range(100_000):
        text = "".join(rnd.choice(marks) if rnd.random() < 0.25 else rnd.choice(plain) for _ in range(rnd.randint(1, 14)))
        assert np.frombuffer(words.encode(text.encode()), dtype=words.dtype).tolist() == words.whole(text), ascii(text)


def pieces(page):
    blocks = {}
    for _, block, piece in html_extract.parse(page).pieces:
        blocks[block] = blocks.get(block, "") + piece
    return [" ".join(b.split()) for b in blocks.values() if b.strip()]


def test_parser_loses_no_text():
    assert pieces("<p>Let <math><mi>x</mi><mo>=</mo><mn>1</mn></math> be a number.</p><p>B") == ["Let x=1 be a number.", "B"]
    assert pieces("<article><p>a</p><svg><path d=1><p>tail</p></article><p>more") == ["a", "tail", "more"]  # a drawing that is never closed
    assert pieces("<p>İ</p><SCRIPT>var x='<p>no</p>'</SCRIPT ><p>yes") == ["İ", "yes"]  # one letter grows in lower case
    assert pieces("<p>a <object>fall</object> <noscript>back</noscript> <canvas>c</canvas>") == ["a fall back c"]
    assert pieces("<head><title>open<body></head><p>kept") == ["kept"]
    assert pieces("<select><option>a<option>b</select><p>z<template><p>q</p></template>r") == ["z", "r"]
    assert pieces("<svg><title>t</title><style>.a{}</style><text>hi</text></svg>x") == ["thix"]
    assert pieces("<p>a</p><style>p{}</STYLE><textarea>typed</textarea><p>b<script>endless <p>c") == ["a", "b"]
