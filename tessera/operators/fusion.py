"""Reciprocal rank fusion of the channels, and hybrid search."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.lexical import Limits, lexical_recall, with_tokens, within
from tessera.operators.symbols import symbol_recall
from tessera.operators.vector import Identity, vector_recall
from tessera.plans.tables import materialize

CHANNELS = ("lexical", "vector", "symbol")
# The constant of the fusion and the reasons shown.
RRF_K, REASONS = 60, 4


def rrf(hits: DataFrame, limit: int | Limits | None = 10, k: int = RRF_K) -> DataFrame:
    """Fused candidates (query_id, repo, id, score, rank, scores, ranks, reasons); the score is rounded before the last ordering."""
    order = F.create_map(*[x for i, c in enumerate(CHANNELS) for x in (F.lit(c), F.lit(i))])[F.col("channel")]
    best = hits.groupBy("query_id", "repo", "id", "channel").agg(F.sum(1 / (k + F.col("rank"))).alias("part"), F.max("raw_score").alias("raw_score"), F.min("rank").alias("rank"), F.array_sort(F.collect_set(F.struct("rank", "reason"))).alias("reasons"))
    entries = F.array_sort(F.collect_list(F.struct(order.alias("at"), "channel", "raw_score", "rank", "reasons")))
    fused = best.groupBy("query_id", "repo", "id").agg(F.round(F.sum("part"), 6).alias("score"), entries.alias("e"))
    by_name = F.array_sort(F.transform("e", lambda x: F.struct(x["channel"].alias("channel"), x["raw_score"].alias("raw_score"), x["rank"].alias("rank"))))
    fused = fused.select(
        "query_id", "repo", "id", "score",
        F.map_from_entries(F.transform(by_name, lambda x: F.struct(x["channel"], x["raw_score"]))).alias("scores"),
        F.map_from_entries(F.transform(by_name, lambda x: F.struct(x["channel"], x["rank"]))).alias("ranks"),
        F.array_distinct(F.flatten(F.transform("e", lambda x: F.transform(x["reasons"], lambda r: r["reason"])))).alias("reasons"),
    )
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.coalesce("repo", F.lit("")), "id")
    fused = fused.withColumn("rank", F.row_number().over(w))
    return within(fused, "rank", limit) if limit is not None else fused


def score_parts(fused: DataFrame) -> DataFrame:
    """fused with keyword, lexical, vector, symbol and rrf as columns; 0 where a channel is absent."""
    part = lambda c: F.round(F.coalesce(F.col("scores")[c], F.lit(0.0)), 6)
    return fused.select("*", part("lexical").alias("keyword"), part("lexical").alias("lexical"), part("vector").alias("vector"), part("symbol").alias("symbol"), F.round("score", 6).alias("rrf"))


def match_reason(fused: DataFrame) -> DataFrame:
    shown = F.array_join(F.slice("reasons", 1, REASONS), "; ")
    return fused.withColumn("match_reason", F.when(F.size("reasons") > 0, shown).otherwise("no match"))


def trace(hits: DataFrame) -> DataFrame:
    """(query_id, channel, candidate_count, hits)."""
    rows = F.array_sort(F.collect_list(F.struct("rank", "repo", "id", "raw_score", "reason")))
    return hits.groupBy("query_id", "channel").agg(F.count(F.lit(1)).alias("candidate_count"), rows.alias("hits"))


def recall(items: DataFrame, embeddings: DataFrame | None, symbols: DataFrame, queries: DataFrame, limit: int | Limits = 10, identity: Identity | None = None, domain_terms: Sequence[str] = (), cjk: bool = True) -> DataFrame:
    """The hits of all channels. Queries with a column vector take part in the vector channel."""
    queries = with_tokens(queries, domain_terms, cjk)
    hits = lexical_recall(items, queries, limit, domain_terms, cjk).unionByName(symbol_recall(symbols, items, queries, limit, domain_terms, cjk))
    if embeddings is not None and "vector" in queries.columns:
        hits = hits.unionByName(vector_recall(items, embeddings, queries, limit, identity))
    return hits


def hybrid_search(items: DataFrame, embeddings: DataFrame | None, symbols: DataFrame, queries: DataFrame, limit: int | Limits = 10, identity: Identity | None = None, domain_terms: Sequence[str] = (), cjk: bool = True) -> DataFrame:
    """The fused top of each query: the texts are not in it, join them by (repo, id)."""
    return match_reason(score_parts(rrf(recall(items, embeddings, symbols, queries, limit, identity, domain_terms, cjk), limit)))


def stale(items: DataFrame, queries: DataFrame, hits: DataFrame, domain_terms: Sequence[str] = (), cjk: bool = True) -> DataFrame:
    """(query_id, stale): whether a query that asks for a commit found nothing, but would without the commit."""
    if "commit_sha" not in queries.columns or not queries.where("commit_sha is not null").limit(1).count():
        return queries.select("query_id", F.lit(False).alias("stale"))
    queries = with_tokens(queries, domain_terms, cjk)
    missed = materialize(queries.where("commit_sha is not null").join(hits.select("query_id").distinct(), "query_id", "left_anti"), "missed")
    found = lexical_recall(items, missed.drop("commit_sha"), 1, domain_terms, cjk).select("query_id", F.lit(True).alias("found")).distinct()
    return queries.select("query_id").join(found, "query_id", "left").select("query_id", F.coalesce("found", F.lit(False)).alias("stale"))


def cross_repo(results: DataFrame) -> DataFrame:
    """(query_id, repos, cross_repo): whether a query's results come from several repos."""
    return results.groupBy("query_id").agg(F.countDistinct("repo").alias("repos")).withColumn("cross_repo", F.col("repos") > 1)
