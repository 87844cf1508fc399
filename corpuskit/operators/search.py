"""Search, ranking and browsing of the method corpus."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuskit.functions.labels import figure_order_keys
from corpuskit.functions.text import fold, normalize_method_name
from corpuskit.operators.dictionary import mention_pairs
from corpuskit.operators.ordered import top_k
from corpuskit.session import staged

RESULTS_SHOWN = 20


def rank_matches(
    methods: DataFrame, queries: Sequence[str], k: int = RESULTS_SHOWN, name: str = "name"
) -> DataFrame:
    """The k best methods per query: name equal (0), alias equal (1), name prefix (2), alias prefix (3), name contains (4),
    folded description contains (5); then by folded name and name.

    ``methods(name, aliases array, category, parent_method)``.  The queries are literals of the caller, so every method row
    scores them in place; each task keeps its k best per query before the shuffle.
    """
    none = F.array().cast("array<string>")
    aliases = F.coalesce("aliases", none)
    described = methods.select(
        name,
        normalize_method_name(name).alias("__name"),
        F.transform(aliases, lambda a: normalize_method_name(a)).alias("__aliases"),
        fold(
            F.concat_ws(
                " ", F.coalesce(name, F.lit("")), F.array_join(aliases, " "),
                F.coalesce("category", F.lit("")), F.coalesce("parent_method", F.lit("")),
            )
        ).alias("__blob"),
    )
    asked = F.array(*[F.struct(F.lit(q).alias("query"), normalize_method_name(F.lit(q)).alias("norm")) for q in queries])
    rows = described.withColumn("__q", F.explode(asked)).withColumns({"query": F.col("__q.query"), "__norm": F.col("__q.norm")})
    q = F.col("__norm")
    tier = (
        F.when(F.col("__name") == q, 0)
        .when(F.array_contains("__aliases", q), 1)
        .when(F.col("__name").startswith(q), 2)
        .when(F.exists("__aliases", lambda a: a.startswith(q)), 3)
        .when(F.col("__name").contains(q), 4)
        .when(F.col("__blob").contains(q), 5)
    )
    scored = rows.where(q != "").withColumn("tier", tier).where("tier IS NOT NULL").select("query", name, "tier")
    return top_k(scored, ["query"], [F.asc("tier"), fold(name).asc(), F.asc(name)], k, rank="rank")


PREFIX = 3


def _described(methods: DataFrame, name: str) -> DataFrame:
    """(name, norm, norms of the aliases, blob) per method."""
    aliases = F.coalesce("aliases", F.array().cast("array<string>"))
    blob = F.concat_ws(" ", F.coalesce(name, F.lit("")), F.array_join(aliases, " "), F.coalesce("category", F.lit("")), F.coalesce("parent_method", F.lit("")))
    return methods.select(
        F.col(name).alias("__name"), normalize_method_name(name).alias("norm"), F.transform(aliases, lambda a: normalize_method_name(a)).alias("alias_norms"), fold(blob).alias("blob")
    )


def rank_matches_table(methods: DataFrame, queries: DataFrame, k: int = RESULTS_SHOWN, name: str = "name", query: str = "query") -> DataFrame:
    """``rank_matches`` for a table of queries: (query, name, tier, rank), the k best methods of every distinct query.

    The tiers are a cascade of joins.  Names and aliases that equal or begin with the query are found by their first ``PREFIX`` characters; only queries
    that these leave short of k methods look for names and descriptions that contain them, by ``mention_pairs``.  Neither step compares all queries with all
    methods; each task keeps its k best per query before ranks are dealt out.  Names are unique; a null query or name takes no part.
    """
    described = staged(_described(methods.where(F.col(name).isNotNull()), name), "search-methods")
    asked = staged(queries.select(F.col(query).alias("query"), normalize_method_name(query).alias("__norm")).where("query IS NOT NULL AND __norm != ''").distinct(), "search-queries")
    keys = lambda s: F.array_distinct(F.transform(F.sequence(F.lit(1), F.lit(PREFIX)), lambda n: F.left(s, n)))
    strings = described.select("__name", F.col("norm").alias("string"), F.lit(0).alias("add")).union(
        described.select("__name", F.explode("alias_norms").alias("string"), F.lit(1))
    )
    filed = strings.where("string != ''").select("*", F.explode(keys(F.col("string"))).alias("__key"))
    begun = asked.withColumn("__key", F.left("__norm", F.lit(PREFIX))).join(filed, "__key").where(F.startswith("string", F.col("__norm")))
    tier = F.when(F.col("string") == F.col("__norm"), 0).otherwise(2) + F.col("add")
    first = begun.groupBy("query", "__name").agg(F.min(tier).alias("tier"))
    first = staged(top_k(first, ["query"], [F.asc("tier"), fold("__name").asc(), F.asc("__name")], k), "search-first")

    enough = first.groupBy("query").agg(F.count("*").alias("n")).where(F.col("n") >= k)
    short = asked.join(enough, "query", "left_anti")
    norms = short.select("__norm").distinct()
    inside = mention_pairs(described.select("__name", "norm"), norms, "__name", "norm", "__norm").select("__name", "__norm", F.lit(4).alias("tier"))
    blobs = mention_pairs(described.select("__name", "blob"), norms, "__name", "blob", "__norm").select("__name", "__norm", F.lit(5).alias("tier"))
    later = short.join(inside.union(blobs), "__norm").select("query", "__name", "tier")
    best = first.unionByName(later).groupBy("query", "__name").agg(F.min("tier").alias("tier"))
    ranked = top_k(best, ["query"], [F.asc("tier"), fold("__name").asc(), F.asc("__name")], k, rank="rank")
    return ranked.select("query", F.col("__name").alias(name), "tier", "rank")


def scoped_search(papers: DataFrame, keyword: str, scope: str = "both", figures_only: bool = False) -> DataFrame:
    """Papers whose title and / or figure captions hold the keyword; adds ``matching_figures``.

    ``papers(title, figures array<struct<figure, caption>>)``; an empty keyword passes everything.
    """
    figures = F.coalesce("figures", F.array().cast(papers.schema["figures"].dataType))
    word = keyword.casefold()

    def has(c: Column) -> Column:
        return F.contains(fold(c), F.lit(word)) if word else F.lit(True)

    out = papers.withColumn("matching_figures", F.filter(figures, lambda f: has(f["caption"])))
    in_title, in_caption = has(F.col("title")), F.size("matching_figures") > 0
    if word:
        out = out.where({"title": in_title, "caption": in_caption, "both": in_title | in_caption}[scope])
    return out.where(F.size(figures) > 0) if figures_only else out


def by_name(df: DataFrame, name: str) -> DataFrame:
    """Case-insensitive order, the spelling breaks ties."""
    return df.orderBy(fold(name), name)


def by_figure(df: DataFrame, label: str) -> DataFrame:
    """Figure number (9999 without one), letter suffix, label."""
    return df.orderBy(*figure_order_keys(label))


def ordered_path(items: Column, order: str = "order", default: int = 999) -> Column:
    """Items of a learning path by their order, items without one last.  Equal orders keep their place."""
    placed = F.transform(
        items, lambda x, i: F.struct(F.coalesce(x[order], F.lit(default)).alias("o"), i.alias("i"), x.alias("x"))
    )
    return F.transform(F.array_sort(placed), lambda p: p["x"])


def representative_figure(figures: DataFrame, keys: Sequence[str]) -> DataFrame:
    """First figure with a cached image per method, else its first figure.

    ``figures(*keys, has_image, paper_pos, figure_pos, ...)``.
    """
    rest = [c for c in figures.columns if c not in keys]
    order = F.struct(~F.col("has_image"), F.col("paper_pos"), F.col("figure_pos"))
    return figures.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("__f")).select(*keys, "__f.*")


def method_stats(links: DataFrame, method: str, paper: str) -> DataFrame:
    """Papers and figures per method: one row of ``links`` is one figure."""
    per_paper = links.groupBy(method, paper).agg(F.count("*").alias("__n"))
    return per_paper.groupBy(method).agg(F.count("*").alias("paper_count"), F.sum("__n").alias("figure_count"))


def co_usage(links: DataFrame, paper: str, method: str) -> DataFrame:
    """Papers that use two methods together, per unordered pair.

    Papers with the same method set are merged first and carry a weight, so a pair is emitted once per distinct set and not
    once per paper.  A set cannot outgrow the method vocabulary.
    """
    sets = links.groupBy(paper).agg(F.array_sort(F.collect_set(method)).alias("__set"))
    weighted = sets.where(F.size("__set") > 1).groupBy("__set").agg(F.count("*").alias("__w"))
    firsts = weighted.select("__set", "__w", F.posexplode("__set").alias("__i", "method_a"))
    pairs = firsts.select(
        "method_a", "__w", F.explode(F.slice("__set", F.col("__i") + 2, F.size("__set"))).alias("method_b")
    )
    return pairs.groupBy("method_a", "method_b").agg(F.sum("__w").alias("paper_count"))


def top_co_used(pairs: DataFrame, k: int = 4) -> DataFrame:
    """The k methods most used together with each method."""
    both = F.explode(
        F.array(
            F.struct(F.col("method_a").alias("method"), F.col("method_b").alias("co_method")),
            F.struct(F.col("method_b").alias("method"), F.col("method_a").alias("co_method")),
        )
    )
    rows = pairs.select(both.alias("p"), "paper_count").select("p.*", "paper_count")
    return top_k(rows, ["method"], [F.desc("paper_count"), F.asc("co_method")], k, rank="rank")
