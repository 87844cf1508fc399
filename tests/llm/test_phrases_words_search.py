"""Spelling groups, exact search and phrase collocations against brute force, with odd inputs."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuskit.llm import block_search, collocations, spelling_groups

# spelling groups


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def test_sliced_index_by_brute_force():
    rnd = random.Random(3)
    for _ in range(120):
        words = list({"".join(rnd.choice("abß") for _ in range(rnd.randint(1, 6))) for _ in range(40)})
        index = spelling_groups.SlicedIndex(words)
        for q in [*words, "abab", "c"]:
            same, longer, less = index.near(q)
            for found, difference in ((same, 0), (longer, 1), (less, -1)):
                got = {words[i] for i in range(len(words)) if found >> i & 1}
                assert got == {w for w in words if near(q, w) and len(w) - len(q) == difference}


def slow_words(rows):
    counts = Counter()
    for doc_id, text in rows:
        run = ""
        for ch in (text or "") + " ":
            if ("A" <= ch <= "Z") or ("a" <= ch <= "z") or ("À" <= ch <= "ÿ"):
                run += ch.lower() if ch < "\x7f" else ch
                continue
            if run:
                h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
                if h % 31 == 0:
                    run = run[: h % len(run)] + run[h % len(run) + 1 :]
                counts[run] += len(run) >= 7
            run = ""
    return {w: n for w, n in counts.items() if n >= 2}


def slow_groups(words):
    forms, out = {}, {}
    for w, n in words.items():
        around = [v for v in words if near(w, v)]
        best = min(around, key=lambda v: (-words[v], v), default=None)
        forms[w] = best if best is not None and words[best] >= 10 * n else None
        out[w] = (n, len(around), words[forms[w]] if forms[w] else None)
    for w in words:
        root = w
        while forms[root]:
            root = forms[root]
        out[w] = (forms[w], root, *out[w])
    return out


def groups_of(df, **options):
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in spelling_groups.group_spellings(df, **options).collect()}


def test_spelling_groups_by_brute_force(spark):
    rnd = random.Random(5)
    stems = ["bananas", "bananaß", "cabbages", "Ünïcödé", "ÀÉÎõüÿ×", "abababa", "babababa", "aaaaaaa", "aaaaaaaa"]
    rows = [(None, "bananas Bananas"), (7, None), (8, ""), (9, "short runs only"), (9, "x" * 30_000 + " " + "x" * 30_000), (3, "Straßen-bahnen3bahnhof")]
    for i in range(300):
        words = []
        for _ in range(rnd.randint(1, 40)):
            w = rnd.choice(stems[: 1 + int(rnd.expovariate(0.5)) % len(stems)])
            if rnd.random() < 0.08:
                at = rnd.randrange(len(w))
                w = rnd.choice((w[:at] + w[at + 1 :], w[:at] + "e" + w[at:], w[:at] + "o" + w[at + 1 :]))
            words.append(w.upper() if rnd.random() < 0.1 else w)
        rows.append((i % 250, rnd.choice((" ", ", ", "-")).join(words)))
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, text string, word string, n int")
    want = slow_groups(slow_words(rows))
    assert len(want) > 60 and sum(v[0] is not None for v in want.values()) > 10
    assert groups_of(df) == want
    assert groups_of(df, tile=5) == want  # most blocks in slices


def test_spelling_chains_and_edges(spark, documents, nothing):
    counts = {"aaaaaaa": 2, "aaaaaab": 20, "aaaaabb": 200, "aaaabbb": 1999}  # each is near the next; the last is less than ten times
    rows = [(i, w) for i, (w, n) in enumerate(counts.items()) for _ in range(n)]
    rows = [(d, w) for d, w in rows if zlib.crc32(f"{d}:{w}".encode()) % 31]
    got = groups_of(spark.createDataFrame(rows, "doc_id long, text string"))
    assert got == slow_groups(slow_words(rows)) and got["aaaaaaa"][:2] == ("aaaaaab", "aaaaabb") and got["aaaaabb"][0] is None
    assert groups_of(nothing) == {}
    assert groups_of(documents) == slow_groups(slow_words([(r["doc_id"], r["text"]) for r in documents.collect()]))


# exact search


def slow_search(rows, every, k):
    fine = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            fine.setdefault(i, [int(np.floor(256 * float(x))) for x in v])
    out = set()
    for q, a in fine.items():
        if q % every == 0:
            scored = sorted((-sum(x * y for x, y in zip(a, b, strict=False)), i) for i, b in fine.items() if i != q)
            out |= {(q, r, i, -s) for r, (s, i) in enumerate(scored[:k], 1)}
    return out


def vectors(spark, rows, kind="double"):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], f"vec_id long, embedding array<{kind}>, score string, rank int")


def found_in(df, **options):
    return {tuple(r) for r in block_search.top_scores(df, **options).collect()}


@pytest.mark.parametrize("spread", [0.02, 3.0])
def test_exact_search_by_brute_force(spark, spread):
    """Vectors around a few centres (bounds end the search early) and without structure; many equal ones."""
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(6, 8))
    rows = [(i, (centres[i % 6] + spread * rng.normal(size=8)).tolist()) for i in range(700)]
    rows += [(1000 + i, [0.25] * 8) for i in range(90)] + [(2000 + i, [0.0] * 8) for i in range(20)]
    got = found_in(vectors(spark, rows), every=10, block=16, shard=64)
    assert got == slow_search(rows, 10, 5)


def test_blocks_are_left_out_only_below_the_kth():
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(20, 16))
    blocks = []
    for j, c in enumerate(centres):
        x = np.floor(256 * (c + 0.05 * rng.normal(size=(30, 16)))).astype(np.int64)
        blocks.append((np.arange(30) + 100 * j, x, x.max(axis=0), x.min(axis=0)))
    queries = np.floor(256 * (centres + 0.05 * rng.normal(size=centres.shape))).astype(np.int64)
    best, scored = block_search.search_tile(queries, np.full(20, np.iinfo(np.int64).min), blocks, 5)
    assert 20 <= scored < 200  # of 400 pairs of query and block
    for q in range(20):
        every = sorted((-int(v @ queries[q]), int(i)) for ids, x, _, _ in blocks for i, v in zip(ids, x, strict=True))[:5]
        mine = best.query == q
        assert sorted(zip((-best.score[mine]).tolist(), best.cid[mine].tolist(), strict=True)) == every
    bounds = block_search.block_bounds(queries, np.stack([b[2] for b in blocks]), np.stack([b[3] for b in blocks]))
    assert all((bounds[:, j] >= (queries @ x.T).max(axis=1)).all() for j, (_, x, _, _) in enumerate(blocks))


def test_exact_search_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (50, [1.0, 2.0]), (1, None), (2, [None, 1.0]), (3, [nan, 1.0]), (4, [inf, 0.0]), (None, [1.0, 1.0]), (5, []), (6, [3.0]), (7, [1.0, 2.0, 5.0]), (8, [0.0, 0.0]), (100, [-0.001, 0.0])]
    assert found_in(vectors(spark, rows)) == slow_search(rows, 50, 5)
    large = [(i, [1e5 * (i + 1), -3e5]) for i in range(0, 60, 10)]  # products beyond the exact doubles
    assert found_in(vectors(spark, large)) == slow_search(large, 50, 5)
    assert found_in(vectors(spark, [])) == set()
    assert found_in(vectors(spark, [(50, [1.0])])) == set()
    repeated = [(50, [1.0, 0.0]), (50, [1.0, 0.0]), (1, [0.5, 0.5])]
    assert found_in(vectors(spark, repeated, "float")) == slow_search(repeated, 50, 5)


# phrase collocations


def slow_phrases(rows, least=10, shown=2000):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for ch in ".,;:!?\x0b\x0c\r":
            low = low.replace(ch, "\n")
        for piece in low.split("\n"):
            words = [w for w in piece.replace("\t", " ").split(" ") if w]
            n[lang] += len(words)
            for k in (1, 2, 3):
                f[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = set()
    for lang, counts in f.items():
        candidates = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        scored = []
        for p, a in candidates.items():
            if len(p) == 2 and any(100 * b >= 50 * a and p in (q[:2], q[1:]) for q, b in candidates.items() if len(q) == 3):
                continue
            score, _, left, right = min((1_000_000 * a * a // (counts[p[:k]] * counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
            scored.append((-score, -a, " ".join(p).encode(), left, right))
        out |= {(lang, r, p.decode(), -a, left, right, n[lang], -s) for r, (s, a, p, left, right) in enumerate(sorted(scored)[:shown], 1)}
    return out


def phrases_of(df, **options):
    return {tuple(r) for r in collocations.collocations(df, **options).collect()}


def test_collocations_by_brute_force(spark, monkeypatch):
    rnd = random.Random(9)
    line = "The Quick brown fox jumps over the lazy dog"
    rows = [(None, None), (None, ""), ("en", " . ;"), (None, "one two"), ("fr", "Élan élan ÉLAN élan"), ("xx", "a b " * 400), ("yy", "loop " * 60)]
    for i in range(260):
        words = [rnd.choice("abbc") * rnd.randint(1, 2) for _ in range(rnd.randint(0, 30))]
        glue = [rnd.choice((" ", " ", " ", "\t", ", ", "\n", "  ", " ")) for _ in words]
        text = "".join(w + g for w, g in zip(words, glue, strict=True)) + (line if i % 3 else f"{line} {i}.")
        rows.append((("en", "de", None)[i % 3], text))
    df = spark.createDataFrame([(i, *r, 5, "x") for i, r in enumerate(rows)], "doc_id long, lang string, text string, a int, phrase string")
    want = slow_phrases(rows)
    assert len(want) > 50 and {r[0] for r in want} >= {"en", "de", "und", "xx", "yy"}
    assert phrases_of(df) == want
    assert phrases_of(df, shown=3) == {r for r in want if r[1] <= 3}
    # small flushes, every node sliced, and paths cut at other places
    monkeypatch.setattr(collocations, "FLUSH", 40)
    monkeypatch.setattr(collocations, "SAMPLE", 1.0)
    monkeypatch.setattr(collocations, "CUT", 2)
    assert phrases_of(df) == want


def test_unary_paths_are_compacted(spark):
    text = ". ".join(["we thank the reviewers of this paper for all their help"] * 12 + ["the reviewers were kind"] * 15)
    graph = collocations.Graph(spark.createDataFrame([("en", text)], "lang string, text string"))
    counts = {(r["node"]): r["n"] for r in graph.nodes.collect()}
    assert counts["the reviewers"] == 27 and counts["their help"] == 12
    edges = graph.edges.withColumns({"head_n": F.lit(0), "tail_n": F.lit(0)})
    paths = collocations.compact_paths(edges)
    shown = [(r["phrase"], r["least"]) for r in collocations.path_phrases(paths).collect()]
    held = sorted(" ".join(p.split()[i : i + 3]) for p, _ in shown for i in range(len(p.split()) - 2))
    assert held == sorted(r["gram"] for r in graph.edges.collect())  # each edge on one path
    assert len(shown) < len(held) and ("the reviewers were kind", 15) in shown


def test_collocation_edges(spark, documents, nothing):
    assert phrases_of(nothing) == set()
    rows = [(r["lang"], r["text"]) for r in documents.collect()]
    assert phrases_of(documents) == slow_phrases(rows) and phrases_of(documents, least=1) == slow_phrases(rows, least=1)
