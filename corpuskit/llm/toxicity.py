"""Toxicity scores: logistic regression over hashed word n-grams and skip-grams, trained by FTRL-proximal.

Features of a text are the distinct hashes of its words, of their stems (the first four and five letters of longer words), of pairs of neighbours and of
pairs around one skipped word, lower-cased in A-Z and stripped of punctuation at their ends.  Whether a feature is present counts, not how often, so that long texts aren't drowned.  FTRL keeps a learning rate per
coordinate, and its L1 term leaves most weights at exactly zero; the rest are a small table that travels to every task.

Training uses a bounded sample of the labelled rows: at most ``SAMPLE`` of each class, those with the least hash of their id.  The log of the two
sampling rates' ratio corrects the intercept.
"""

from __future__ import annotations

import math
from array import array

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuskit.llm.common import fresh, id_fold, text_udf

BITS = 20
SAMPLE = 8_000
CACHE = 200_000
STRIP = b".,;:!?\"'()[]{}<>|*#$%&"
SCHEMA = "feature int, weight double"
STEMS = (4, 5)


class _Numbers(dict):
    """Row of each word in ``table``: hashes of the word and of its stems.  Kept between texts of a Python worker and emptied when it grows too large."""

    def __init__(self) -> None:
        super().__init__()
        self.table = array("Q")

    def __missing__(self, word: bytes) -> int:
        bare = word.strip(STRIP)
        letters = bare.decode("utf-8", "replace")
        value = self[word] = len(self)
        self.table.append(xxhash.xxh64_intdigest(bare) or 1 if bare else 0)
        self.table.extend(xxhash.xxh64_intdigest(letters[:n].encode(), n) if len(letters) > n else 0 for n in STEMS)
        return value

    def rows(self, words: list[bytes]) -> np.ndarray:
        if len(self) >= CACHE:
            self.clear()
            self.table = array("Q")
        index = np.fromiter(map(self.__getitem__, words), dtype=np.int64, count=len(words))
        return np.array(self.table, dtype=np.uint64, copy=False).reshape(-1, 1 + len(STEMS))[index] if len(index) else np.zeros((0, 1 + len(STEMS)), np.uint64)


_known = _Numbers()


def occurrences(raw: bytes | None, bits: int = BITS) -> np.ndarray:
    """Features of a whole text, repeated as they occur; none for a null text or one without words."""
    rows = _known.rows((raw or b"").lower().split())
    rows = rows[rows[:, 0] != 0]
    ids, stems = rows[:, 0], rows[:, 1:].ravel()
    with np.errstate(over="ignore"):
        two = (ids[:-1] * np.uint64(0xC2B2AE3D27D4EB4F)) ^ (ids[1:] * np.uint64(0x165667B19E3779F9))
        skip = (ids[:-2] * np.uint64(0x27D4EB2F165667C5)) ^ (ids[2:] * np.uint64(0x85EBCA77C2B2AE63))
        mixed = np.concatenate([ids, stems[stems != 0], two, skip]) * np.uint64(0x9E3779B97F4A7C15)
    return (mixed >> np.uint64(64 - bits)).astype(np.int32)


def features(raw: bytes | None, bits: int = BITS) -> np.ndarray:
    """Sorted distinct features of a whole text."""
    return np.unique(occurrences(raw, bits))


def ftrl(rows: list[np.ndarray], labels: np.ndarray, size: int, alpha: float, beta: float, l1: float, l2: float, epochs: int) -> tuple[np.ndarray, float]:
    """Weights and intercept after ``epochs`` passes in the given order.  The intercept has no L1 term."""
    z, n = np.zeros(size + 1), np.zeros(size + 1)
    thresholds = np.full(size + 1, l1)
    thresholds[size] = 0.0
    bias = np.array([size])

    def weights(index: np.ndarray) -> np.ndarray:
        own, sums = z[index], n[index]
        return np.where(np.abs(own) <= thresholds[index], 0.0, (np.sign(own) * thresholds[index] - own) / ((beta + np.sqrt(sums)) / alpha + l2))

    for _ in range(epochs):
        for row, y in zip(rows, labels, strict=True):
            index = np.concatenate([row, bias])
            w = weights(index)
            p = 1 / (1 + math.exp(-min(35.0, max(-35.0, w.sum()))))
            g = p - y
            step = (np.sqrt(n[index] + g * g) - np.sqrt(n[index])) / alpha
            z[index] += g - step * w
            n[index] += g * g
    every = weights(np.arange(size + 1))
    return every[:size], float(every[size])


def _weights(features: list[int], weights: list[float]) -> pa.Table:
    return pa.table({"feature": pa.array(features, pa.int32()), "weight": pa.array(weights, pa.float64())})


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", bits: int = BITS, sample: int = SAMPLE, alpha: float = 2.0, beta: float = 1.0, l1: float = 3.0, l2: float = 0.1, epochs: int = 4) -> DataFrame:
    """(feature, weight) with feature -1 for the intercept.

    ``labels`` has doc_id and toxic; callers leave out what must not be learned.  A document with several labels is toxic if any is 1; null labels and
    ids are left out.  Without labelled rows of both classes, the table holds an intercept of -20 alone: nothing is judged toxic.
    """
    marks = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("y"))
    sizes = {r["y"]: r["count"] for r in marks.groupBy("y").count().collect()}
    order = F.xxhash64(F.col("doc_id").cast("string")), F.col("doc_id")
    chosen = marks.where("y = 1").orderBy(*order).limit(sample).union(marks.where("y = 0").orderBy(*order).limit(sample))
    key = fresh(docs, "t_id")
    learn = docs.select(F.col("doc_id").alias(key), F.col(text).cast("binary").alias("raw")).join(F.broadcast(chosen), F.col(key) == F.col("doc_id"))
    shift = math.log((sizes.get(1, 1) / min(sample, sizes.get(1, 1))) / (sizes.get(0, 1) / min(sample, sizes.get(0, 1))))

    packed = text_udf(lambda raw: features(raw, bits).tobytes(), "binary")

    def train(table: pa.Table) -> pa.Table:
        y = table["y"].to_numpy()
        if len(set(y.tolist())) < 2:
            return _weights([-1], [-20.0])
        # views of Arrow's buffers: the features of the sample are held once
        rows = [np.frombuffer(f.as_buffer(), dtype=np.int32) for part in table["f"].chunks for f in part]
        order = np.random.default_rng(5).permutation(np.lexsort((np.array([r.nbytes for r in rows]), table["doc_id"].to_numpy())))
        w, bias = ftrl([rows[i] for i in order], y[order], 1 << bits, alpha, beta, l1, l2, epochs)
        used = np.flatnonzero(w)
        return _weights([-1, *used.tolist()], [bias + shift, *w[used].tolist()])

    rows = learn.select(F.col(key).cast("bigint").alias("doc_id"), "y", packed(F.col("raw")).alias("f"))
    return rows.groupBy().applyInArrow(train, SCHEMA)


def scorer(weights: DataFrame, bits: int = BITS):
    """Column function from a text to its score between 0 and 1.  At most 2 ** bits + 1 weights are collected; L1 leaves far fewer."""
    table = weights.toPandas()
    bias = float(table.loc[table["feature"] < 0, "weight"].sum()) if len(table) else -20.0
    table = table[table["feature"] >= 0].sort_values("feature")
    index, weight = table["feature"].to_numpy(np.int32), table["weight"].to_numpy()

    held: list[np.ndarray] = []  # by feature: weight and whether it has one; made once per task, as only the table travels

    def score(raw: bytes | None) -> float:
        if not held:
            dense, used = np.zeros(1 << bits), np.zeros(1 << bits, dtype=bool)
            dense[index], used[index] = weight, True
            held.extend((dense, used))
        dense, used = held
        found = occurrences(raw, bits)
        total = dense[np.unique(found[used[found]])].sum() + bias
        return float(1 / (1 + np.exp(-np.clip(total, -35, 35))))

    return text_udf(score, "double")


def train_rows(labels: DataFrame) -> DataFrame:
    return labels.where(id_fold(F.col("doc_id"), 3) != 1)


def score_documents(docs: DataFrame, labels: DataFrame, text: str = "text", threshold: float = 0.7) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs``; a null or empty text scores by the intercept alone."""
    judge = scorer(fit(docs, train_rows(labels), text))
    scored = docs.select(F.col("doc_id"), (id_fold(F.col("doc_id"), 3) == 1).alias("held_out"), judge(F.col(text)).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame, text: str = "text", threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``."""
    name = fresh(docs, "t_score")
    judge = scorer(fit(docs, train_rows(labels), text))
    return docs.withColumn(name, judge(F.col(text))).where(F.col(name) < threshold).drop(name)
