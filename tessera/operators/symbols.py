"""The symbol channel: catalog lookup by equality, prefix and substring."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import symbol_terms
from tessera.operators.filters import KINDS, symbol_filter
from tessera.operators.lexical import Limits, ranked, sized, with_tokens, within

# The scores of the ladder.
EXACT, PREFIX, FUZZY = 1.0, 0.85, 0.65
VALUES = ("name", "qualified_name", "symbol_id")


def exact_hit(term: Column) -> Column:
    """Whether a symbol's name, qualified name or id is the term; an empty term hits nothing."""
    return (term != "") & term.isin(*[F.col(v) for v in VALUES])


def prefix_hit(term: Column) -> Column:
    return (term != "") & (F.startswith(F.col("name"), term) | F.startswith(F.col("qualified_name"), term))


def find_exact(symbols: DataFrame, repo: str, query: str, limit: int = 20, **filters) -> DataFrame:
    """Symbols whose name, qualified name or id is the query; nothing for an empty query or limit."""
    return symbol_filter(symbols, repo, **filters).where(exact_hit(F.lit(query))).orderBy("qualified_name", "symbol_id").limit(max(0, limit))


def find_prefix(symbols: DataFrame, repo: str, query: str, limit: int = 20, **filters) -> DataFrame:
    return symbol_filter(symbols, repo, **filters).where(prefix_hit(F.lit(query))).orderBy("qualified_name", "symbol_id").limit(max(0, limit))


def default_kinds(asset_type: Column) -> Column:
    """The kinds an asset type looks for; null for documents, which have no symbols."""
    out = F.lit(None).cast("array<string>")
    for kind, names in KINDS.items():
        if names:
            out = F.when(asset_type == kind, F.array(*map(F.lit, names))).otherwise(out)
    return out


def ladder(symbols: DataFrame, queries: DataFrame) -> DataFrame:
    """Scored symbols: (query_id, repo, symbol_id, qualified_name, source_item_id, score, reason).

    queries has terms, kinds and repo. The best score over all terms of two or
    more characters counts, its reason names the longest term, then the first.
    """
    q = queries.where("repo is not null").select("query_id", F.col("repo").alias("q_repo"), "kinds", "asset_type", *[F.col(c).alias(f"q_{c}") for c in ("path_prefix", "language", "commit_sha") if c in queries.columns], F.filter(F.array_distinct("terms"), lambda t: F.length(t) > 1).alias("terms"))
    cond = (F.col("repo") == F.col("q_repo")) & F.array_contains("kinds", F.col("kind"))
    for name in ("language", "commit_sha"):
        if f"q_{name}" in q.columns:
            cond = cond & (F.col(f"q_{name}").isNull() | (F.col(name) == F.col(f"q_{name}")))
    if "q_path_prefix" in q.columns:
        cond = cond & (F.col("q_path_prefix").isNull() | F.startswith(F.col("path"), F.col("q_path_prefix")))
    low = symbols.withColumn("values", F.array(*[F.lower(v) for v in VALUES]))
    rows = low.join(sized(q), cond)

    def rate(term: Column) -> Column:
        t, values = F.lower(term), F.col("values")
        score = (
            F.when(F.array_contains(values, t), EXACT)
            .when(F.exists(values, lambda v: F.startswith(v, t)), PREFIX)
            .when(F.exists(values, lambda v: F.contains(v, t)), FUZZY)
        )
        return F.struct(F.coalesce(score, F.lit(0.0)).alias("score"), F.length(term).alias("length"), term.alias("term"))

    # the greatest score, of it the longest term, of them the first by name
    best = F.aggregate(
        F.transform("terms", rate),
        F.struct(F.lit(0.0).alias("score"), F.lit(0).alias("length"), F.lit("").alias("term")),
        lambda a, x: F.when((x["score"] > a["score"]) | (x["score"] == a["score"]) & ((x["length"] > a["length"]) | (x["length"] == a["length"]) & (x["term"] < a["term"])), x).otherwise(a),
    )
    word = F.when(F.col("best.score") == EXACT, "exact").when(F.col("best.score") == PREFIX, "prefix").otherwise("fuzzy")
    return rows.withColumn("best", best).where("best.score > 0").select(
        "query_id", "asset_type", "repo", "symbol_id", "qualified_name", "source_item_id", F.col("best.score").alias("score"), F.concat(F.lit("symbol "), word, F.lit(" hit: "), F.col("best.term")).alias("reason")
    )


def items_of_symbols(scored: DataFrame, items: DataFrame, limit: int | Limits = 10) -> DataFrame:
    """The items of scored symbols: dead links and other asset types dropped, the best symbol of an item, the first cap items by (score, qualified name, symbol id)."""
    linked = scored.where("source_item_id is not null").join(items.select("repo", F.col("id").alias("source_item_id"), F.col("asset_type").alias("of")), ["repo", "source_item_id"]).where("of = asset_type")
    best = Window.partitionBy("query_id", "repo", "source_item_id").orderBy(F.desc("score"), "qualified_name", "symbol_id")
    first = linked.withColumn("k", F.row_number().over(best)).where("k = 1")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "qualified_name", "symbol_id")
    return within(first.withColumn("k", F.row_number().over(order)), "k", limit, True).select("query_id", "repo", F.col("source_item_id").alias("id"), "score", "reason")


def with_terms(queries: DataFrame, domain_terms: Sequence[str] = (), cjk: bool = True) -> DataFrame:
    """queries with terms (symbol terms and tokens) and kinds."""
    queries = with_tokens(queries, domain_terms, cjk)
    kinds = default_kinds(F.col("asset_type"))
    if "symbol_types" in queries.columns:
        kinds = F.when(F.size("symbol_types") > 0, F.col("symbol_types")).otherwise(kinds)
    return queries.withColumn("terms", F.array_union(symbol_terms(F.col("query_text")), F.col("tokens"))).withColumn("kinds", F.when(F.col("asset_type").isin("code", "db_schema"), kinds))


def symbol_recall(symbols: DataFrame, items: DataFrame, queries: DataFrame, limit: int | Limits = 10, domain_terms: Sequence[str] = (), cjk: bool = True) -> DataFrame:
    """Hits of the symbol channel; none for queries without a repo or for documents."""
    scored = ladder(symbols, with_terms(queries, domain_terms, cjk))
    return ranked(items_of_symbols(scored, items, limit), "symbol", F.col("reason"))
