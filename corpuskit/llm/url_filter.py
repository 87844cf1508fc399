"""URL filters by host suffix and path prefix.

Every url is expanded into expressions, a suffix of its host followed by a prefix of its path.  Only shapes (number of host labels, length
of the path) that some rule has are expanded, so that the number of expressions depends on the variety of rule shapes and not on the number
of rules.  Expressions meet rules in an equi-join on the first ``PREFIX_HEX`` hex digits of their SHA-256 digest; what the short prefix
lets through is confirmed on the full digest, and the longest confirmed rule decides.

Rules are ordinary rows; Spark broadcasts them where their size is known to be small and otherwise shuffles both sides, with adaptive
skew handling for expressions that many urls share.  Each url keeps a number of its own from expansion to decision, so that no host, however
frequent, gathers in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuskit.llm.common import ascii_lower, fresh

PREFIX_HEX = 8
MAX_HOST = 253  # characters of a host name in DNS, so at most 127 labels
MAX_PATH = 8192  # code points of a rule's path


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; empty without ``://``."""
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\n"), path), 256)


def judge_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """All rows and columns of ``pages`` plus ``host``, ``path``, ``rule`` and ``verdict``.

    ``rules`` has ``action`` (allow or block), ``host`` and ``path``.  A rule fits its host and all subdomains if the path of the url starts
    with the rule's.  The longest rule (host and path together) wins; of equally long ones that with the longer host, then block.
    A null path of a rule is empty; rules with a null or empty host, or another action, fit nothing.  A url that no rule fits, null and empty
    ones too, gets a null rule and the verdict ``default``.  Repeated rows are judged one by one.  Columns of ``pages`` named like the
    four results, or like a helper column, are replaced by the results (helpers get free names).
    """
    keep = [c for c in pages.columns if c.lower() not in ("host", "path", "rule", "verdict")]
    known = (
        rules.where(F.col("action").isin("allow", "block") & (F.coalesce("host", F.lit("")) != ""))
        .select("action", ascii_lower(F.col("host")).alias("host"), F.coalesce("path", F.lit("")).alias("path"))
        .distinct()
    )
    shapes = known.agg(
        F.collect_set(F.struct(F.size(F.split("host", r"\.")).alias("labels"), F.length("path").alias("length"))).alias("s"),
        F.max(F.length("host")).alias("host"),
        F.max(F.length("path")).alias("path"),
    ).first()
    if (shapes["host"] or 0) > MAX_HOST or (shapes["path"] or 0) > MAX_PATH:
        raise ValueError(f"a rule's host has at most {MAX_HOST} characters and its path {MAX_PATH}")
    row, hosts, paths, labels, key, full, best = (fresh(pages, f"u_{n}") for n in ("row", "host", "path", "labels", "key", "full", "best"))
    urls = pages.withColumn(row, F.monotonically_increasing_id()).withColumns({hosts: url_host(F.col(url)), paths: url_path(F.col(url))})
    parts = F.split(F.col(hosts), r"\.")

    def expression(labels_: int, length: int) -> Column:
        suffix = F.when(F.size(parts) == labels_, F.col(hosts)).otherwise(F.substring_index(F.col(hosts), ".", -labels_))
        fits = (F.size(parts) >= labels_) & (F.length(paths) >= length)
        return F.when(fits, _digest(suffix, F.substring(F.col(paths), 1, length) if length else F.lit("")))

    found = F.filter(F.array(*[expression(s["labels"], s["length"]) for s in sorted(shapes["s"])]), lambda e: e.isNotNull()) if shapes["s"] else F.array().cast("array<string>")
    expanded = urls.select("*", F.explode_outer(found).alias(full)).withColumn(
        key, F.coalesce(F.substring(full, 1, PREFIX_HEX), F.concat(F.lit("-"), F.col(row).cast("string")))
    )
    listed = known.select(
        F.substring(_digest(F.col("host"), F.col("path")), 1, PREFIX_HEX).alias(f"{key}r"),
        _digest(F.col("host"), F.col("path")).alias(f"{full}r"),
        F.struct(
            (F.length("host") + F.length("path")).alias("size"),
            F.length("host").alias("host_size"),
            (F.col("action") == "block").cast("int").alias("block"),
            F.concat("host", "path").alias("rule"),
        ).alias(f"{best}r"),
    )
    met = expanded.join(listed, F.col(key) == F.col(f"{key}r"), "left").withColumn(
        best, F.when(F.col(full) == F.col(f"{full}r"), F.col(f"{best}r"))
    )
    groups = [row, hosts, paths, *keep]
    decided = met.groupBy(*groups).agg(F.max(best).alias(best))
    return decided.select(
        *keep,
        F.col(hosts).alias("host"),
        F.col(paths).alias("path"),
        F.col(f"{best}.rule").alias("rule"),
        F.when(F.col(f"{best}.block") == 1, "block").when(F.col(f"{best}.block") == 0, "allow").otherwise(F.lit(default)).alias("verdict"),
    )
