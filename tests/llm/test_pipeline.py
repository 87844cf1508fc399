import random
from collections import Counter

import corpus_pipeline
from corpuskit.llm import mixing, packing, quality_rules, simhash_dedup, toxicity

FOLDER = "/root/testdata/sf0.01"


def test_stages_follow_the_operators(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, FOLDER).cache()
        ids = Counter(r["doc_id"] for r in docs.select("doc_id").collect())
        after = Counter(r["doc_id"] for r in out.select("doc_id").collect())
        if name != "best-fit packing":
            assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        if name == "toxicity":
            want = Counter(r["doc_id"] for r in toxicity.score_documents(docs, labels).where("predicted = 0").collect())
        elif name == "quality rules":
            want = Counter(r["doc_id"] for r in quality_rules.judge_quality(docs, labels).where("kept").collect())
        elif name == "near duplicates":
            groups = simhash_dedup.group_documents(docs).collect()
            want = Counter({r["component_id"]: 1 for r in groups})
        elif name == "source mixing":
            mixed, p = mixing.mix(docs)
            want = Counter({r["doc_id"]: r[f"{p}copies"] for r in mixed.collect()})
            want = +want
        else:
            words = Counter()
            for r in docs.collect():
                words[r["doc_id"]] += len((r["text"] or "").encode().split())
            placed = Counter()
            for r in out.collect():
                placed[r["doc_id"]] += r["length"]
            assert +placed == +words and set(after) == set(ids)
            assert out.columns == packing.pack(docs).columns
            return
        assert after == want, name
        docs = out


def test_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality rules", "near duplicates", "source mixing", "best-fit packing"]


def test_near_duplicates_follow_the_general_rule(spark):
    rng = random.Random(4)
    rows, pairs = [], []
    for i in range(60):
        words = [f"w{i}x{k}" for k in range(200)]
        edited = list(words)
        for at in rng.sample(range(195), 2 + i % 3):  # each edit changes at most five of 196 shingles
            edited[at] = "edit"
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(edited))]
        pairs.append((2 * i, 2 * i + 1))
    far = [f"w0x{k}" if k % 12 else "other" for k in range(200)]
    docs = spark.createDataFrame([*rows, (500, " ".join(far))], "doc_id long, text string")
    shingle_sets = {d: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for d, t in [*rows, (500, " ".join(far))]}
    jaccard = lambda a, b: len(shingle_sets[a] & shingle_sets[b]) / len(shingle_sets[a] | shingle_sets[b])
    assert all(jaccard(a, b) >= 0.8 for a, b in pairs) and jaccard(0, 500) < 0.8
    kept = {r["doc_id"] for r in corpus_pipeline.near_duplicate_stage(spark, docs, FOLDER).collect()}
    assert kept == {a for a, _ in pairs} | {500}
