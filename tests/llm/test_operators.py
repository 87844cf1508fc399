import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuskit.llm import ann_forest, brown_lm, mixing, packing, quality_rules, simhash_dedup, toxicity, url_filter
from corpuskit.llm.components import components

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


# url filter


def slow_verdict(url, rules, default="allow"):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [(len(h + p), len(h), a == "block", h + p, a) for a, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits)[3:] if fits else (None, default)))


RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"), ("block", "x.y", ""), ("allow", "x.y", "")]


def test_urls_match_brute_force(spark):
    random.seed(3)
    urls = [None, "", "no scheme", "http://", "http://EXAMPLE.org/es/1?x", "http://a.b.example.org/en/12#t", "https://org/", "ftp://org", "http://nexample.org/es/", "http://x.y", "http://a.x.y?q/://z", "http://com/de/" + "x" * 20000]
    urls += ["".join(random.choice(["http://", "a.", "example.org", "com", "/", "es/", "en/1", "fr/", "?", "#", "://", "ORG"]) for _ in range(random.randint(1, 9))) for _ in range(300)]
    urls += urls[:5]
    pages = spark.createDataFrame([(i, u, "old", "k") for i, u in enumerate(urls)], "page_id long, url string, verdict string, u_key string")
    rules = spark.createDataFrame([*RULES, ("allow", None, "/"), ("deny", "com", "/"), ("block", "", "/")], "action string, host string, path string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge_urls(pages, rules).collect()}
    assert got == {i: slow_verdict(u, RULES) for i, u in enumerate(urls)}


def test_urls_shuffled_rules_and_no_rules(spark):
    pages = spark.createDataFrame([(1, "http://h1.org/p"), (1, "http://h1.org/p"), (2, None)], "page_id long, url string")
    rules = spark.range(3000).select(F.lit("block").alias("action"), F.format_string("h%d.org", "id").alias("host"), F.lit("/").alias("path"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = sorted(tuple(r) for r in url_filter.judge_urls(pages, rules).select("page_id", "rule", "verdict").collect())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert rows == [(1, "h1.org/", "block"), (1, "h1.org/", "block"), (2, None, "allow")]
    none = url_filter.judge_urls(pages, rules.limit(0)).collect()
    assert len(none) == 3 and all(r["rule"] is None for r in none)
    assert url_filter.judge_urls(pages.limit(0), rules).count() == 0
    with pytest.raises(ValueError):
        url_filter.judge_urls(pages, rules.withColumn("path", F.repeat(F.lit("x"), 9000)))


def test_urls_run_without_python(spark):
    pages = spark.createDataFrame([(1, "http://h1.org/p")], "page_id long, url string")
    plan = url_filter.judge_urls(pages, spark.createDataFrame(RULES, "action string, host string, path string"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Cartesian" not in plan


# quality


def slow_measures(text):
    words = WORD.findall(text or "")
    windows = Counter(zip(words, words[1:], words[2:], strict=False))
    covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = [line for line in (text or "").split("\n") if WORD.search(line)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_measures_match_brute_force(spark):
    random.seed(1)
    texts = ["".join(random.choice(["a ", "b ", "c\n", "ab\t", "é ", "* ", "|", "A", "\x0b", " "]) for _ in range(random.randint(0, 120))) for _ in range(400)]
    for t in [*texts, "", "x y z x y z", "a a a a", "\n\n", "q\nq\n q\nq"]:
        assert quality_rules.measure_text(t.encode())[:5] == slow_measures(t), repr(t)
    assert quality_rules.measure_text(None)[:5] == (0, 0, 0, 0, 0)


def test_binomial_bound():
    assert quality_rules.binomial_cdf(0, 100, 0.03) == pytest.approx(0.97**100)
    assert quality_rules.binomial_cdf(2, 5, 0.5) == pytest.approx(0.5)
    assert quality_rules.binomial_cdf(5, 5, 0.5) == 1.0
    assert quality_rules.binomial_cdf(900_000, 100_000_000, 0.01) == pytest.approx(0.0, abs=1e-30)
    dropped = [0] * quality_rules.GRID
    dropped[0] = 50
    assert quality_rules.valid_cutoffs(dropped, 1000, 0.02, 0.01)[-1] == 1
    assert quality_rules.valid_cutoffs([0] * quality_rules.GRID, 10, 0.02, 0.01) == []


def test_quality_learns_a_cutoff_and_keeps_good(spark):
    good = [(i, f"plain words number {i} " + " ".join(f"w{i}x{k}" for k in range(60)), "en") for i in range(3000)]
    bad = [(10_000 + i, " ".join(f"w{i}x{k}###" for k in range(60)), "en") for i in range(300)]
    docs = spark.createDataFrame(good + bad, "doc_id long, text string, lang string").repartition(4)
    labels = docs.select("doc_id", (F.col("doc_id") < 10_000).cast("int").alias("quality"))
    got = {r["doc_id"]: r["kept"] for r in quality_rules.quality_table(docs, labels).collect()}
    assert all(got[i] == (i < 10_000) for i in got) and len(got) == 3300
    assert quality_rules.keep_good(docs, labels).count() == 3000


def test_quality_filters_strata_with_few_labels(spark):
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(60)), ("de", "es", "fr", "en")[i % 4]) for i in range(4 * 250)]
    rows += [(10_000 + i, " ".join(f"w{i}x{k}##" for k in range(60)), ("de", "es", "fr", "en")[i % 4]) for i in range(40)]
    rows += [(20_000 + i, " ".join(f"v{i}x{k}" for k in range(60)), "it") for i in range(150)]
    rows += [(30_000 + i, " ".join(f"v{i}x{k}##" for k in range(60)), "it") for i in range(10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    labels = docs.select("doc_id", ((F.col("doc_id") < 10_000) | F.col("doc_id").between(20_000, 29_999)).cast("int").alias("quality"))
    got = {r["doc_id"]: r["kept"] for r in quality_rules.quality_table(docs, labels).collect()}
    assert all(got[i] == (i < 10_000 or i >= 20_000) for i in got)  # 150 good documents of "it" allow no rule


def test_rule_family_is_nested_and_lax_rules_come_first():
    bad, other = np.zeros((2, 6, quality_rules.GRID + 1))
    bad[:, 0], other[:, 0] = 10, 1000
    bad[0, :], other[0, 0] = 0, 990
    bad[0, 50], other[0, 50], bad[1, 0], bad[1, 3], other[1, 0], other[1, 3] = 10, 10, 5, 5, 500, 500
    firsts, rules = quality_rules.rule_family(bad, other)
    assert (np.diff(firsts, axis=1) <= 0).all() and (firsts[:, 0] == rules).all() and (firsts[2:] == rules).all()
    assert firsts[0, 50] == 0 and 0 < firsts[1, 3] < rules


def test_quality_edges(documents, nothing, marks):
    out = quality_rules.judge_quality(documents, marks)
    assert out.count() == documents.count() and set(documents.columns) <= set(out.columns)
    assert all(r["base_failed"] or r["kept"] for r in out.collect())
    assert quality_rules.judge_quality(nothing, marks).count() == 0
    assert quality_rules.judge_quality(documents, marks.limit(0)).count() == documents.count()


# near duplicates


def slow_fingerprint(text, width=4):
    import xxhash

    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints_match_brute_force_and_sql(spark, documents):
    for text in ["a b c d e f", "one", "One TWO three four", "", "é É x y z é É x y z", "a a a a a a a"]:
        assert simhash_dedup.fingerprint(text.encode()) == slow_fingerprint(text)
    got = {r["doc_id"]: r["fp"] % 2**64 for r in simhash_dedup.fingerprints(documents).collect()}
    assert got == {r["doc_id"]: slow_fingerprint(r["text"]) for r in documents.collect()}
    whole = spark.sql("SELECT xxhash64('one two three four') AS h").first()["h"] % 2**64
    assert simhash_dedup.fingerprint(b"one two three four") == whole


def slow_components(prints, radius):
    nodes = sorted(set(prints))
    parent = {n: n for n in nodes}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for i, a in enumerate(nodes):
        for b in nodes[i + 1 :]:
            if ((a ^ b) % 2**64).bit_count() <= radius:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize(("bands", "tile"), [(1, 16_384), (2, 7), (3, 3)])
def test_tiles_lose_no_link(spark, bands, tile):
    rng = random.Random(5)
    prints = []
    for _ in range(25):
        p = rng.getrandbits(64)
        for _ in range(rng.randint(1, 9)):
            prints.append(p)
            for _ in range(rng.randint(1, 4)):
                p ^= 1 << rng.randrange(64)
    prints += [0, 1, 3, 2**64 - 1, 2**64 - 2]
    signed = [p - 2**64 if p >= 2**63 else p for p in prints]
    frame = spark.createDataFrame([(p,) for p in signed], "fp long")
    got = {r["fp"]: r["root"] for r in simhash_dedup.near_components(frame, 4, bands, tile).collect()}
    want = slow_components(signed, 4)
    groups = lambda m: {frozenset(k for k in m if m[k] == v) for v in m.values()}
    assert groups(got) == groups(want)


def test_components_of_chains_and_stars(spark):
    chain = [(i + 1, i) for i in range(60)] + [(100, 200), (200, 300), (150, 300), (5, 5), (None, 4)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {i: 100 for i in (100, 150, 200, 300)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_groups_and_survivors(documents, nothing):
    got = Counter((r["doc_id"], r["component_id"]) for r in simhash_dedup.group_documents(documents).collect())
    assert got[1, 1] == 1 and got[2, 1] == 1 and got[3, 3] == got[4, 3] == got[5, 3] == 1 and got[8, 8] == 2 and sum(got.values()) == 10
    kept = simhash_dedup.keep_one(documents)
    assert kept.columns == documents.columns
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 3, 6, 7, 8]
    assert simhash_dedup.group_documents(nothing).count() == 0 and simhash_dedup.keep_one(nothing).count() == 0


@pytest.mark.parametrize("options", [{}, {"width": 4, "radius": 4, "similar": None}])
def test_one_row_of_each_component_with_odd_ids(spark, options):
    a, b, c = (" ".join(f"{x}{k}" for k in range(40)) for x in "abc")
    rows = [(5, a), (5, b), (3, b), (None, c), (None, c), (None, a), (9, ""), (9, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = [(r["doc_id"], r["text"] or "") for r in simhash_dedup.keep_one(docs, **options).collect()]
    assert sorted(kept, key=str) == sorted([(5, a), (3, b), (None, c), (9, "")], key=str)


# packing


def test_packing_keeps_every_word_once(spark, documents, nothing):
    for lengths, group in (((4, 8, 16), 3), ((1,), 100), ((256, 512, 1024, 2048, 4096), 20_000)):
        rows = packing.pack(documents, lengths=lengths, group=group).collect()
        words = Counter()
        bins = defaultdict(list)
        for r in rows:
            words[r["doc_id"]] += r["length"]
            if r["bin"] is not None:
                bins[r["bin"]].append(r)
        assert words == Counter({r["doc_id"]: 0 for r in documents.collect()}) + sum((Counter({r["doc_id"]: len(WORD.findall(r["text"] or ""))}) for r in documents.collect()), Counter())
        for held in bins.values():
            spans = sorted((r["bin_start"], r["bin_start"] + r["length"]) for r in held)
            assert spans[0][0] == 0 and all(a[1] == b[0] for a, b in zip(spans, spans[1:], strict=False))
            filled, capacity = held[0]["bin_filled"], held[0]["bin_length"]
            assert spans[-1][1] == filled <= capacity and capacity == min(c for c in lengths if c >= filled)
    assert packing.pack(nothing).count() == 0


def slow_best_fit(pieces, lengths, cost):
    bins, left = [], sum(pieces)
    for size in pieces:
        fits = [b for b in bins if b[0] - b[1] >= size]
        if fits:
            best = min(b[0] - b[1] for b in fits)
            chosen = [b for b in fits if b[0] - b[1] == best][0]
        else:
            chosen = [min((c for c in lengths if c >= size), key=lambda c: (cost(c) / min(c, left), c)), 0]
            bins.append(chosen)
        chosen[1] += size
        left -= size
    return sorted(b[1] for b in bins)


def test_best_fit_matches_brute_force():
    rng = np.random.default_rng(0)
    lengths = (16, 32, 64)
    for _ in range(30):
        pieces = np.sort(rng.integers(1, 65, size=rng.integers(1, 80)))[::-1]
        bins, starts, sizes, filled = packing.pack_group(pieces, lengths)
        assert sum(filled) == pieces.sum() and all(f <= s for f, s in zip(filled, sizes, strict=True))
        assert len(filled) == len(slow_best_fit(pieces.tolist(), lengths, packing.sequence_cost))
        assert set(np.bincount(bins, weights=pieces).astype(int)) == set(filled)


# toxicity


def test_ftrl_finds_the_word_and_is_sparse():
    rng = random.Random(2)
    texts = [" ".join(f"w{rng.randrange(300)}" for _ in range(40)) + (" Nasty!" if i % 4 == 0 else "") for i in range(800)]
    rows = [toxicity.features(t.encode()) for t in texts]
    y = np.array([i % 4 == 0 for i in range(800)], dtype=int)
    w, bias = toxicity.ftrl(rows, y, 1 << toxicity.BITS, 2.0, 1.0, 3.0, 0.1, 4)
    scores = np.array([w[r].sum() for r in rows]) + bias
    assert ((scores > 0) == y).all() and 0 < np.count_nonzero(w) < 500


def test_toxicity_edges(spark, documents, nothing, marks):
    rows = toxicity.score_documents(documents, marks).collect()
    assert len(rows) == 10 and all(0 <= r["score"] <= 1 and r["predicted"] == 0 for r in rows if r["doc_id"] not in (1, 2))
    assert all(r["held_out"] == (zlib.crc32(b"" if r["doc_id"] is None else str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    assert toxicity.score_documents(nothing, marks).count() == 0
    assert all(r["predicted"] == 0 for r in toxicity.score_documents(documents, marks.limit(0)).collect())
    assert toxicity.drop_toxic(documents, marks.limit(0)).columns == documents.columns


def test_toxicity_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    scored = toxicity.score_documents(docs, labels).where("held_out").join(labels, "doc_id").select("score", "toxic").toPandas().sort_values("score")
    ranks = np.arange(1, len(scored) + 1)
    toxic = scored["toxic"].to_numpy() == 1
    auc = (ranks[toxic].mean() - (toxic.sum() + 1) / 2) / (~toxic).sum()
    assert auc > 0.95


# mixing


def slow_targets(sizes):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        rest, weights = total - sum(3 * sizes[s] for s in capped), sum(weight[s] for s in names if s not in capped)
        targets = {s: 3.0 * sizes[s] if s in capped else rest * weight[s] / weights for s in names}
        over = {s for s in names if s not in capped and targets[s] > 3 * sizes[s]}
        if not over:
            return targets
        capped |= over


def test_targets_and_copies(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    mixed, p = mixing.mix(docs)
    rows = mixed.select("source", *[F.col(f"{p}{c}").alias(c) for c in ("size", "source_size", "target", "copies", "taken")]).collect()
    sizes = Counter()
    for r in rows:
        sizes[r["source"]] += r["size"]
    want = slow_targets(sizes)
    taken, largest = Counter(), Counter()
    for r in rows:
        largest[r["source"]] = max(largest[r["source"]], r["size"])
        assert r["target"] == pytest.approx(want[r["source"]]) and r["source_size"] == sizes[r["source"]]
        assert 0 <= r["copies"] <= 3 and r["taken"] == r["copies"] * r["size"]
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - want[s]) <= 0.03 * want[s] + largest[s] / 5 for s in want)
    emitted = mixing.emit(docs).groupBy("doc_id").count().count()
    assert emitted == sum(r["copies"] > 0 for r in rows)


def test_mixing_edges(documents, nothing):
    mixed, p = mixing.mix(documents)
    rows = mixed.collect()
    assert len(rows) == 10 and all(r[f"{p}taken"] <= 3 * r[f"{p}size"] for r in rows)
    assert {r["m_size"] for r in rows} == {1}
    assert mixing.emit(documents).columns == documents.columns
    assert mixing.mix(nothing)[0].count() == 0


# nearest neighbours


def test_neighbours_recall_and_scores(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    got = ann_forest.nearest(vectors).toPandas()
    table = vectors.toPandas()
    x, ids = np.stack(table["embedding"]).astype(float), table["vec_id"].to_numpy()
    hits = total = 0
    for q in ids[ids % 20 == 0]:
        scores = x @ x[ids == q][0]
        mine = got[got["query_id"] == q].sort_values("rank")
        order = [i for i in np.lexsort((ids, -scores)) if ids[i] != q][:20]
        assert len(mine) == 20 and list(mine["rank"]) == list(range(1, 21))
        assert np.allclose(mine["score"], [scores[ids == v][0] for v in mine["vec_id"]])
        hits += len(set(mine["vec_id"]) & set(ids[order]))
        total += 20
    assert hits / total >= 0.9


def test_neighbours_edges(spark):
    nan = float("nan")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 2.0]), (3, [0.0, 0.0]), (4, None), (5, [nan, 1.0]), (6, [None, 1.0]), (7, [1.0]), (None, [1.0, 1.0]), (20, [1.0, 0.0]), (20, [1.0, 0.0]), (40, [3.0, 1.0])]
    frame = spark.createDataFrame([(i, v, 0, "x") for i, v in rows], "vec_id long, embedding array<float>, cid int, string string")
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in ann_forest.nearest(frame).collect())
    assert got == [
        (0, 1, 40, 3.0), (0, 2, 1, 1.0), (0, 3, 20, 1.0), (0, 4, 2, 0.0),
        (20, 1, 40, 3.0), (20, 2, 0, 1.0), (20, 3, 1, 1.0), (20, 4, 2, 0.0),
        (40, 1, 0, 3.0), (40, 2, 1, 3.0), (40, 3, 20, 3.0), (40, 4, 2, 2.0),
    ]
    assert ann_forest.nearest(frame.limit(0)).count() == 0
    many = spark.createDataFrame([(i, [1.0, 0.5]) for i in range(200)], "vec_id long, embedding array<double>")
    lists = ann_forest.nearest(many).groupBy("query_id").agg(F.sort_array(F.collect_list("vec_id")).alias("v")).collect()
    assert len(lists) == 10 and all(r["v"] == [i for i in range(22) if i != r["query_id"]][:20] for r in lists)


# language model


def test_base_scores_match_brute_force_and_classes_help(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = brown_lm.score_documents(docs).toPandas().set_index("doc_id")
    counts = Counter()
    texts = {r["doc_id"]: [*r["text"].encode().lower().split(), None] for r in docs.select("doc_id", "text").collect()}
    for i, tokens in texts.items():
        if zlib.crc32(str(i).encode()) % 5 != 1:
            counts.update(tokens)
    n, v = sum(counts.values()), len(counts)
    for i, tokens in texts.items():
        want = sum(np.log10((counts[t] + 0.5) / (n + 0.5 * (v + 1))) for t in tokens)
        assert got["base_score"][i] == pytest.approx(want) and got["n_known"][i] == sum(counts[t] > 0 for t in tokens) and got["n_tokens"][i] == len(tokens)
    assert (got["train_tokens"] == n).all()
    held = got[got["held_out"]]
    assert held["score"].sum() > held["base_score"].sum()


def test_language_model_edges(spark, documents, nothing):
    rows = brown_lm.score_documents(documents, classes=4, rounds=2).collect()
    assert len(rows) == 10 and all(np.isfinite(r["score"]) and r["score"] < 0 for r in rows)
    assert brown_lm.score_documents(nothing).count() == 0


def test_language_model_scores_by_brute_force(spark, monkeypatch):
    """Classes of all words, then every count and probability anew in Python; the words that follow a class sum up to one."""
    monkeypatch.setattr(brown_lm, "FREQUENT", 24)
    monkeypatch.setattr(brown_lm, "SEQUENTIAL", 9)
    rng = np.random.default_rng(2)
    words = [f"w{i}x{i % 7}" for i in range(90)]
    texts = {i: [words[min(89, int(rng.exponential(12)))] for _ in range(int(rng.integers(0, 40)))] + [f"once{i}"] * (i % 3 == 0) for i in range(60)}
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in texts.items()], "doc_id long, text string")
    fitted = brown_lm.fit(docs, classes=5, rounds=3)
    listed = {w.decode(): i for i, w in enumerate(fitted.model.words, 1)}
    assert len(listed) <= 24 and fitted.model.clustered == 9
    links = {r["row"]: r["links"] for r in fitted.others.where("row IS NOT NULL").collect()}
    rows = {r["doc_id"]: r["row"] for r in fitted.ids.collect()}
    of_word = {w: int(fitted.of_ids[i]) for w, i in listed.items()}
    for i, tokens in texts.items():
        rest = [t for t in tokens if t not in listed]
        classes = brown_lm.link_pairs(links[rows[i]])[0].tolist() if rest else []
        assert len(classes) == len(rest)
        for t, c in zip(rest, classes, strict=True):
            assert of_word.setdefault(t, c) == c and c != 0
    training = {i: t for i, t in texts.items() if zlib.crc32(str(i).encode()) % 5 != 1}
    counts = Counter(t for tokens in training.values() for t in tokens)
    moves, size = np.zeros((5, 5)), np.zeros(5)
    for tokens in training.values():
        path = [0, *[of_word[t] for t in tokens], 0]
        np.add.at(moves, (path[:-1], path[1:]), 1)
    size = moves.sum(axis=0)
    kinds = Counter(of_word[t] for t in counts)
    share = (size + 0.5) / (size.sum() + 2.5)
    after = (moves + brown_lm.PULL * share) / (moves.sum(axis=1, keepdims=True) + brown_lm.PULL)
    emit = lambda t: (counts[t] + 0.5) / (size[of_word[t]] + 0.5 * (kinds[of_word[t]] + 1))
    got = {r["doc_id"]: r["score"] for r in brown_lm.score_documents(docs, classes=5, rounds=3).collect()}
    for i, tokens in texts.items():
        path = [0, *[of_word[t] for t in tokens], 0]
        want = sum(np.log10(after[a, b]) for a, b in zip(path, path[1:], strict=False)) + sum(np.log10(emit(t)) for t in tokens)
        assert got[i] == pytest.approx(want)
    unseen = {c: 0.5 / (size[c] + 0.5 * (kinds[c] + 1)) for c in range(1, 5)}
    for a in range(5):
        whole = after[a, 0] + sum(after[a, c] * (sum(emit(t) for t in counts if of_word[t] == c) + unseen[c]) for c in range(1, 5))
        assert whole == pytest.approx(1)


def test_exchange_separates_two_languages():
    rng = np.random.default_rng(1)
    words = [np.arange(1, 21), np.arange(21, 41)]
    of_unit = np.concatenate([[0], 1 + np.arange(40) % 2])
    tokens = []
    for _ in range(600):
        tokens += [0, *rng.choice(words[rng.integers(2)], 12)]
    tokens = np.array([*tokens, 0])
    for _ in range(6):
        before, after = np.zeros((41, 3)), np.zeros((41, 3))
        np.add.at(before, (tokens[1:], of_unit[tokens[:-1]]), 1)
        np.add.at(after, (tokens[:-1], of_unit[tokens[1:]]), 1)
        of_unit = brown_lm.exchange(before, after, of_unit, 3)
    assert len(set(of_unit[1:21])) == 1 and len(set(of_unit[21:])) == 1 and of_unit[1] != of_unit[21]


def test_many_words_are_exchanged_as_one_is():
    rng = np.random.default_rng(7)
    before, after = rng.integers(0, 9, (30, 6)).astype(float), rng.integers(0, 9, (30, 6)).astype(float)
    of_unit = np.concatenate([[0], 1 + np.arange(29) % 5])
    # totals are large enough to take a word out of its class
    words = np.sort(rng.integers(0, 12, 80))
    words = np.unique(words, return_inverse=True)[1]
    left, right, own = rng.integers(0, 6, 80), rng.integers(0, 6, 80), rng.integers(1, 6, words.max() + 1)
    chosen = brown_lm.Exchange(before * 9, after * 9, of_unit, 6)
    got = chosen.best_many(words, left, right, own)
    for w in range(words.max() + 1):
        sides = (np.bincount(x[words == w], minlength=6).astype(float) for x in (left, right))
        assert got[w] == chosen.best(*sides, int(own[w]))


def test_ftrl_by_brute_force():
    """Weights by the update rule one coordinate at a time, in plain Python."""
    rnd = random.Random(11)
    size, alpha, beta, l1, l2, epochs = 12, 0.7, 1.3, 1.5, 0.2, 3
    rows = [sorted(rnd.sample(range(size), rnd.randint(0, 6))) for _ in range(50)]
    labels = [int(3 in r or (5 in r and rnd.random() < 0.6)) for r in rows]
    z, n = [0.0] * (size + 1), [0.0] * (size + 1)

    def weight(i):
        limit = 0.0 if i == size else l1
        return 0.0 if abs(z[i]) <= limit else (np.sign(z[i]) * limit - z[i]) / ((beta + n[i] ** 0.5) / alpha + l2)

    for _ in range(epochs):
        for r, y in zip(rows, labels, strict=True):
            own = {i: weight(i) for i in [*r, size]}
            g = 1 / (1 + np.exp(-sum(own.values()))) - y
            for i, w in own.items():
                z[i] += g - ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / alpha * w
                n[i] += g * g
    w, bias = toxicity.ftrl([np.array(r, dtype=np.int32) for r in rows], np.array(labels), size, alpha, beta, l1, l2, epochs)
    assert w == pytest.approx([weight(i) for i in range(size)]) and bias == pytest.approx(weight(size))
    assert 0 < np.count_nonzero(w) < size


def test_toxicity_scores_by_brute_force(spark):
    """Scores of texts from the weights of a fit, feature by feature."""
    docs = spark.createDataFrame([(i, f"{'vile' if i % 3 == 0 else 'nice'} Word{i % 7}, and more words here!") for i in range(90)] + [(200, None), (201, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(90)], "doc_id long, toxic int")
    table = {r["feature"]: r["weight"] for r in toxicity.fit(docs, toxicity.train_rows(labels)).collect()}
    for r in toxicity.score_documents(docs, labels).join(docs, "doc_id").collect():
        total = table[-1] + sum(table.get(int(f), 0.0) for f in toxicity.features((r["text"] or "").encode()))
        assert r["score"] == pytest.approx(1 / (1 + np.exp(-total))) and r["predicted"] == (r["score"] >= 0.7)
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
