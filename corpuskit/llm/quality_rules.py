"""Quality rules whose cutoffs are chosen under a controlled risk.

Measures of a text grow with junk.  Each stratum (language) has one nested family of rules; a rule is a cutoff for every measure, and each rule drops all
that the laxer ones drop.  A value's odds are the share of labelled bad documents at or above it by the share of unlabelled documents there (a uniform
pseudo-document is added, so that odds exist without any); a rule drops what reaches its odds in some measure, and rules run from high odds to low.
The family doesn't depend on the labelled good documents.  On them, rules are tested from the laxest to stricter ones up to the first failure
(fixed-sequence testing): a rule is valid if the exact binomial test rejects "it drops more than ``risk`` of the good documents" (the Clopper-Pearson
upper bound of the share that it drops lies below ``risk``).  A stratum costs one test level; strata share ``error`` by Bonferroni.  With probability at least
``1 - error``, therefore, no stratum loses more than ``risk`` of its good documents, whichever valid rules are used.  Used is the one that separates
bad from good best (share of bad dropped minus share of good dropped; the laxest of equals), and none without gain.  Strata whose holdout is too
small for any valid rule (four strata at the defaults: below 217 good documents) keep everything.

Counts come from all rows: measures are aggregated to histograms, then labelled rows to counts per rule; only these reach a task.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuskit.llm.common import fresh, text_udf
from corpuskit.session import staged

MEASURES = ("symbols", "repeats", "dup_lines", "capitals", "bangs", "pipes")
GRID = 200  # measures lie in 0..1 and are cut to multiples of 1 / GRID
MAX_STRATA = 1000

BASE = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint"
_FIELDS = BASE + ", " + ", ".join(f"{m} int" for m in MEASURES)
_SYMBOLS = b"#*$%&|<>"
_UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def repeated_words(words: list[bytes]) -> int:
    """Number of words that lie in a window of three words that the text holds twice or more."""
    n = len(words)
    if n < 4:
        return 0
    numbers = {w: i for i, w in enumerate(dict.fromkeys(words))}
    v = len(numbers)
    if v == n:
        return 0
    ids = np.fromiter(map(numbers.__getitem__, words), dtype=np.int64, count=n)
    pairs = ids[:-1] * v + ids[1:]
    if v < 2_000_000:
        windows = pairs[:-1] * v + ids[2:]
    else:  # three ids don't fit into 64 bits: number the pairs first
        windows = np.unique(pairs, return_inverse=True)[1][:-1].astype(np.int64) * v + ids[2:]
    twice = pd.Index(windows).duplicated(keep=False)
    covered = np.zeros(n, dtype=bool)
    for shift in range(3):
        covered[shift : shift + n - 2] |= twice
    return int(covered.sum())


def _share(part: float, whole: float) -> int:
    return 0 if whole <= 0 else min(GRID, int(GRID * part / whole))


def measure_text(raw: bytes | None) -> tuple[int, ...]:
    """The base counts and the measures, in multiples of 1 / GRID."""
    raw = raw or b""
    words = raw.split()
    n = len(words)
    spaces = len(raw) - sum(map(len, words))
    chars = len(raw.decode("utf-8", "replace")) - spaces
    symbols = len(raw) - len(raw.translate(None, _SYMBOLS))
    seen: set[bytes] = set()
    lines = dup = 0
    for line in raw.split(b"\n"):
        if line in seen:
            dup += 1
        elif line.strip():
            seen.add(line)
        else:
            continue
        lines += 1
    repeats = repeated_words(words)
    upper, lower = len(raw) - len(raw.translate(None, _UPPER)), len(raw) - len(raw.translate(None, _UPPER.lower()))
    return (
        n, chars, symbols, dup, repeats,
        _share(symbols, chars), _share(repeats, n), _share(dup, lines), _share(upper, upper + lower),
        _share(raw.count(b"!"), n), _share(raw.count(b"|"), n),
    )


def measures(text: Column) -> Column:
    """Struct of the base counts and the measures of a whole text; null counts as empty."""
    return text_udf(measure_text, _FIELDS)(text)


def binomial_cdf(k: int, n: int, p: float) -> float:
    """P(X <= k) for X binomial(n, p), summed downwards from k until terms no longer count."""
    if k >= n:
        return 1.0
    log_term = math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p)
    total, ratio = 0.0, 1.0
    for i in range(k, -1, -1):
        total += ratio
        ratio *= i * (1 - p) / ((n - i + 1) * p)
        if i < n * p and ratio < total * 1e-17:
            break
    return min(1.0, math.exp(log_term + math.log(total)))


def valid_cutoffs(dropped: list[int], n: int, risk: float, level: float) -> list[int]:
    """The valid cutoffs, laxest first.  ``dropped[c]``: how many of n good documents cutoff c drops; the last is the laxest."""
    valid = []
    for cutoff in range(len(dropped) - 1, -1, -1):
        if n == 0 or binomial_cdf(dropped[cutoff], n, risk) > level:
            break
        valid.append(cutoff)
    return valid


def rule_family(bad: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, int]:
    """(first rule that drops each value, number of rules) from histograms (measures, GRID + 1) of bad and of unlabelled documents.

    Rules are numbered from the laxest; a value that none drops has the number of rules.
    """
    above = lambda h: np.cumsum(h[:, ::-1], axis=1)[:, ::-1]
    even = 1 - np.arange(GRID + 1) / (GRID + 1)
    odds = above(bad) / np.maximum(1, bad.sum(axis=1, keepdims=True)) * (other.sum(axis=1, keepdims=True) + 1) / (above(other) + even)
    odds[:, 0] = 0  # no rule drops the least value
    odds = np.maximum.accumulate(odds, axis=1)
    steps = np.unique(odds[odds > 0])[::-1]
    return np.where(odds > 0, np.searchsorted(-steps, -odds), len(steps)).astype(np.int32), len(steps)


def fit_cutoffs(labelled: DataFrame, stratum: str, good: str, measured: str, risk: float = 0.02, error: float = 0.05) -> DataFrame:
    """(stratum, measure, cutoff, n_good, dropped): one row per stratum with a valid useful rule and measure that the rule cuts.

    ``labelled`` holds the stratum, a boolean ``good`` and the struct ``measured``; ``dropped`` counts good rows that the whole rule drops.  Rows with a
    null label only shape the family of rules; a null stratum is one of its own.
    """
    values = [F.col(f"{measured}.{m}").alias(m) for m in MEASURES]
    rows = staged(labelled.select(F.col(stratum).cast("string").alias("stratum"), F.col(good).alias("good"), *values), "measures")
    marked = rows.where("good IS NOT NULL")
    strata = marked.select("stratum").distinct()
    number = strata.count()
    if number > MAX_STRATA:
        raise ValueError(f"{number} labelled strata; at most {MAX_STRATA} are allowed")
    level = error / max(1, number)

    cells = rows.where("good IS NULL OR NOT good").select("stratum", "good", F.posexplode(F.array(*MEASURES)).alias("m", "value"))
    counts = cells.groupBy("stratum", "m", "value").agg(F.count("good").alias("n_bad"), F.count_if(F.col("good").isNull()).alias("n_other"))

    def make(pdf: pd.DataFrame) -> pd.DataFrame:
        held = np.zeros((2, len(MEASURES), GRID + 1))
        for k, kind in enumerate(("n_bad", "n_other")):
            np.add.at(held[k], (pdf["m"].to_numpy(), pdf["value"].to_numpy()), pdf[kind].to_numpy())
        firsts, rules = rule_family(*held)
        return pd.DataFrame({"of": [pdf["stratum"].iloc[0]], "firsts": [firsts.ravel().tolist()], "rules": [rules]})

    families = staged(counts.groupBy("stratum").applyInPandas(make, "of string, firsts array<int>, rules int").where("rules > 0"), "rules")
    first = F.least(*[F.get("firsts", F.lit(k * (GRID + 1)) + F.col(m)) for k, m in enumerate(MEASURES)])
    known = marked.join(families, F.col("stratum").eqNullSafe(F.col("of"))).select("stratum", "good", first.alias("rule"))
    dropped = known.groupBy("stratum", "rule").agg(F.count_if("good").alias("n_good"), F.count_if(~F.col("good")).alias("n_bad"))

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        firsts, rules = np.array(pdf["firsts"].iloc[0]).reshape(len(MEASURES), GRID + 1), int(pdf["rules"].iloc[0])
        held = {}
        for kind in ("n_good", "n_bad"):
            held[kind] = np.zeros(rules + 1, dtype=np.int64)
            np.add.at(held[kind], pdf["rule"].to_numpy(), pdf[kind].to_numpy())
        n, bad = int(held["n_good"].sum()), int(held["n_bad"].sum())
        good_out, bad_out = (np.cumsum(held[kind])[:rules].tolist() for kind in ("n_good", "n_bad"))
        gain = lambda r: bad_out[r] / max(1, bad) - good_out[r] / max(1, n)
        valid = [rules - 1 - c for c in valid_cutoffs(good_out[::-1], n, risk, level)]
        rule = max(valid, key=lambda r: (gain(r), -r), default=None)
        out = []
        if rule is not None and gain(rule) > 0:
            kept = (firsts > rule).sum(axis=1) - 1  # firsts never rise along a measure, so this is its largest kept value
            out = [(pdf["stratum"].iloc[0], m, int(c), n, good_out[rule]) for m, c in zip(MEASURES, kept, strict=True) if c < GRID]
        return pd.DataFrame(out, columns=["stratum", "measure", "cutoff", "n_good", "dropped"])

    tested = dropped.join(families, F.col("stratum").eqNullSafe(F.col("of"))).drop("of")
    return tested.groupBy("stratum").applyInPandas(choose, "stratum string, measure string, cutoff int, n_good bigint, dropped bigint")


def base_failed(measured: str) -> Column:
    m = F.col(measured)
    return (m["n_words"] < 50) | (100 * m["n_repeat_words"] > 50 * m["n_words"])


def passes(cutoffs: DataFrame, stratum: Column, measured: str) -> Column:
    """Whether all cutoffs of the row's stratum hold.  At most MAX_STRATA times the number of measures rows are collected."""
    chosen: dict[str | None, dict[str, int]] = {}
    for r in cutoffs.collect():
        chosen.setdefault(r["stratum"], {})[r["measure"]] = r["cutoff"]
    fine = F.lit(True)
    for name, limits in sorted(chosen.items(), key=lambda x: (x[0] is None, x[0] or "")):
        within = F.lit(True)
        for measure, cutoff in sorted(limits.items()):
            within = within & (F.col(f"{measured}.{measure}") <= cutoff)
        fine = fine & (~stratum.cast("string").eqNullSafe(F.lit(name)) | within)
    return fine


def fit_on_labels(measured: DataFrame, labels: DataFrame, risk: float = 0.02, error: float = 0.05) -> DataFrame:
    """Cutoffs from (doc_id, stratum, measured) rows and ``labels`` (doc_id, quality); only documents that pass the base count.  Unlabelled documents count only for
    the family of rules.

    A document with several labels is good only if all are 1; null labels and ids count as none.  An empty ``labels`` gives no cutoffs.
    """
    marks = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg((F.min("quality") == 1).alias("good"))
    return fit_cutoffs(measured.where(~base_failed("measured")).join(marks, "doc_id", "left"), "stratum", "good", "measured", risk, error)


RESULTS = [f.split()[0] for f in BASE.split(", ")] + ["base_failed", "kept"]


def _judged(df: DataFrame, keep: list[str], cutoffs: DataFrame, stratum: Column, held: str) -> DataFrame:
    verdict = ~base_failed(held) & passes(cutoffs, stratum, held)
    return df.select(*keep, *[F.col(f"{held}.{c}").alias(c) for c in RESULTS[:5]], base_failed(held).alias("base_failed"), verdict.alias("kept"))


def judge_quality(docs: DataFrame, labels: DataFrame, text: str = "text", stratum: str = "lang", risk: float = 0.02, error: float = 0.05) -> DataFrame:
    """All rows and columns of ``docs`` plus the base counts, ``base_failed`` and ``kept``.

    Texts are measured twice, once to fit the cutoffs and once to judge, so that they never leave their rows.  Null and empty texts have no words and
    fail the base.  A null stratum is one of its own.  Columns of ``docs`` named like a result are replaced.
    """
    held = fresh(docs, "q_measured")
    known = docs.select("doc_id", F.col(stratum).alias("stratum"), measures(F.col(text)).alias("measured"))
    cutoffs = fit_on_labels(known, labels, risk, error)
    keep = [c for c in docs.columns if c.lower() not in RESULTS]
    return _judged(docs.select("*", measures(F.col(text)).alias(held)), keep, cutoffs, F.col(stratum), held)


def quality_table(docs: DataFrame, labels: DataFrame, text: str = "text", stratum: str = "lang", risk: float = 0.02, error: float = 0.05) -> DataFrame:
    """Like ``judge_quality`` without the texts: (doc_id, base counts, base_failed, kept).  Texts are measured once, the small measures are staged."""
    known = staged(docs.select("doc_id", F.col(stratum).alias("stratum"), measures(F.col(text)).alias("measured")), "quality")
    return _judged(known, ["doc_id"], fit_on_labels(known, labels, risk, error), F.col("stratum"), "measured")


def keep_good(docs: DataFrame, labels: DataFrame, text: str = "text", stratum: str = "lang", risk: float = 0.02, error: float = 0.05) -> DataFrame:
    """The rows of ``docs`` that ``judge_quality`` keeps, with the columns of ``docs``."""
    held = fresh(docs, "q_measured")
    known = docs.select("doc_id", F.col(stratum).alias("stratum"), measures(F.col(text)).alias("measured"))
    cutoffs = fit_on_labels(known, labels, risk, error)
    judged = docs.withColumn(held, measures(F.col(text)))
    return judged.where(~base_failed(held) & passes(cutoffs, F.col(stratum), held)).drop(held)
