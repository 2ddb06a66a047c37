"""The lexical channel: keyword candidates, weighted term frequencies and BM25 over the candidates.

Relations are keyed by query_id, so one plan serves one request or a batch.
queries: query_id, query_text, repo, asset_type and optionally path_prefix,
language, symbol_types, table_name, commit_sha, tokens.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import flat_metadata, query_tokens, text_tokens
from tessera.operators.filters import haystack
from tessera.plans.tables import materialize

# The weight of each field.
WEIGHTS = {"title": 3.0, "summary": 1.8, "content": 1.0, "metadata": 1.5, "symbol": 4.0, "table": 4.0, "column": 4.0, "heading_path": 3.0, "path": 1.2}
COLUMN_OF = {"table": "table_name", "column": "column_name"}
K1, B = 1.2, 0.75
#: most rows and bytes of a relation that is broadcast; a larger one is shuffled
BROADCAST_ROWS, BROADCAST_BYTES = 20_000, 32 << 20
#: bytes that a value of each type counts for at least
_WIDTH = {"string": 24, "array": 24, "map": 48}


@dataclass(frozen=True)
class Limits:
    """A limit that differs from query to query, and the greatest of them."""

    each: Column
    most: int


def spread(df: DataFrame, least: int = 32, most: int = 2000) -> DataFrame:
    """df over enough tasks for work that is heavy for each row: up to all cores for few rows, at most so many rows in a task."""
    rows, cores = df.count(), df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(1, -(-rows // most), min(cores, -(-rows // least))), "repo", "id")


def within(df: DataFrame, place: str, limit: int | Limits, candidates: bool = False) -> DataFrame:
    """The rows whose place is within the limit, or within a channel's candidates for it. A constant bound comes first, as it is applied before the shuffle."""
    most = limit if isinstance(limit, int) else limit.most
    df = df.where(F.col(place) <= (max(most * 3, 20) if candidates else most))
    if isinstance(limit, int):
        return df
    return df.where(F.col(place) <= (F.greatest(limit.each * 3, F.lit(20)) if candidates else limit.each))


def _bytes(field) -> Column:
    """Bytes of a value, about."""
    kind, c = field.dataType.typeName(), F.col(f"`{field.name}`")
    if kind == "string":
        return F.coalesce(F.octet_length(c), F.lit(0)) + _WIDTH[kind]
    if kind == "array":
        inner = field.dataType.elementType.typeName()
        each = F.aggregate(c, F.lit(0), lambda s, x: s + F.coalesce(F.octet_length(x), F.lit(0)) + 24) if inner == "string" else F.size(c) * (8 if inner in ("double", "long", "integer", "float") else 64)
        return F.coalesce(each, F.lit(0)) + _WIDTH[kind]
    return F.lit(_WIDTH.get(kind, 16))


def sized(df: DataFrame, rows: int = BROADCAST_ROWS, most: int = BROADCAST_BYTES) -> DataFrame:
    """df, marked for broadcast if it is counted to have at most so many rows and bytes."""
    n, size = df.limit(rows + 1).select(sum((_bytes(f) for f in df.schema.fields), F.lit(0)).cast("long").alias("b")).agg(F.count(F.lit(1)), F.coalesce(F.sum("b"), F.lit(0))).first()
    return F.broadcast(df) if n <= rows and size <= most else df


def with_tokens(queries: DataFrame, domain_terms: Sequence[str] = (), cjk: bool = True) -> DataFrame:
    return queries if "tokens" in queries.columns else queries.withColumn("tokens", query_tokens(F.col("query_text"), domain_terms, cjk))


def _asked(queries: DataFrame) -> DataFrame:
    """queries with their columns prefixed by q_, but query_id."""
    return queries.select("query_id", *[F.col(c).alias(f"q_{c}") for c in queries.columns if c != "query_id"])


def _filters(columns: Sequence[str]) -> Column:
    """The filters of the queries' columns that there are, on the items' columns."""
    have, cond = set(columns), F.lit(True)
    for column in ("asset_type", "language", "table_name", "commit_sha"):
        if f"q_{column}" in have:
            cond = cond & (F.col(f"q_{column}").isNull() | (F.col(column) == F.col(f"q_{column}")))
    if "q_path_prefix" in have:
        cond = cond & (F.col("q_path_prefix").isNull() | F.startswith(F.col("path"), F.col("q_path_prefix")))
    if "q_symbol_types" in have:
        cond = cond & (F.coalesce(F.size("q_symbol_types"), F.lit(0)).isin(0, -1) | F.array_contains(F.col("q_symbol_types"), F.col("symbol_type")))
    return cond


def scoped(items: DataFrame, queries: DataFrame) -> DataFrame:
    """Each query's filters on all items, as an equi-join on repo for the queries that have one. Query columns come prefixed with q_, but query_id."""
    named = _asked(queries)
    cond = _filters(named.columns)
    out = items.join(sized(named.where("q_repo is not null")), (F.col("repo") == F.col("q_repo")) & cond)
    anywhere = named.where("q_repo is null")
    # a request without a repo reads everything; these are few and stated
    return out.unionByName(items.join(sized(anywhere), cond)) if anywhere.limit(1).count() else out


def token_hits(items: DataFrame, queries: DataFrame) -> DataFrame:
    """(items' columns of _NARROW, token): the tokens asked of each item's repo, or of any, that its text holds.

    A text is searched once for each distinct token, however many queries ask
    for it, and goes no further.
    """
    asked = queries.select("repo", F.explode("tokens").alias("token")).distinct()
    by_repo = asked.where("repo is not null").groupBy("repo").agg(F.collect_set("token").alias("own"))
    # one row
    anywhere = asked.where("repo is null").agg(F.collect_set("token").alias("any"))
    rows = items.select(*_NARROW, haystack().alias("hay")).join(sized(by_repo), "repo", "left").join(F.broadcast(anywhere))
    tokens = F.array_union(F.coalesce("own", F.array().cast("array<string>")), F.col("any"))
    return rows.select(*_NARROW, F.explode(F.filter(tokens, lambda t: F.contains(F.col("hay"), t))).alias("token"))


_NARROW = ("repo", "id", "asset_type", "language", "table_name", "commit_sha", "path", "symbol_type")


def keyword_candidates(items: DataFrame, queries: DataFrame, limit: int | Limits = 10) -> DataFrame:
    """(query_id, repo, id, match_count, place): the items that hold most of each query's tokens, cut to the candidate cap; ties by id, then repo."""
    hits = token_hits(items, queries)
    asked = _asked(queries)
    keep = ["query_id", *[c for c in asked.columns if c[2:] in ("repo", "asset_type", "language", "table_name", "commit_sha", "path_prefix", "symbol_types")]]
    asked = sized(asked.select(*keep, F.explode("q_tokens").alias("asked")))
    # an item and a query meet under each token that they share
    met = hits.join(asked, (F.col("token") == F.col("asked")) & (F.col("q_repo").isNull() | (F.col("repo") == F.col("q_repo"))) & _filters(keep))
    rows = met.groupBy("query_id", "repo", "id").agg(F.count(F.lit(1)).cast("int").alias("match_count"))
    w = Window.partitionBy("query_id").orderBy(F.desc("match_count"), "id", F.coalesce("repo", F.lit("")))
    return within(rows.withColumn("place", F.row_number().over(w)), "place", limit, True)


def with_fields(candidates: DataFrame, items: DataFrame) -> DataFrame:
    """(query_id, repo, id, fields of WEIGHTS): the candidates with the texts that are scored."""
    fields = [COLUMN_OF.get(name, name) for name in WEIGHTS]
    # written, as counting them would search all texts once more
    found = materialize(candidates.select("query_id", "repo", "id"), "found")
    return items.select("repo", "id", *fields).join(sized(found), ["repo", "id"]).select("query_id", "repo", "id", *fields)


def postings(candidates: DataFrame, domain_terms: Sequence[str] = (), cjk: bool = True) -> DataFrame:
    """(query_id, repo, id, token, wtf, fields): weighted term frequency of each token over the fields."""
    fields = []
    for name, weight in WEIGHTS.items():
        text = flat_metadata(F.col("metadata")) if name == "metadata" else F.col(COLUMN_OF.get(name, name))
        fields.append(F.struct(F.lit(name).alias("field"), F.lit(weight).alias("weight"), text.alias("text")))
    long = candidates.select("query_id", "repo", "id", F.explode(F.array(*fields)).alias("f")).select("query_id", "repo", "id", "f.field", "f.weight", F.explode(text_tokens(F.col("f.text"), domain_terms, cjk)).alias("token"))
    return long.groupBy("query_id", "repo", "id", "token").agg(F.sum("weight").alias("wtf"), F.array_sort(F.collect_set("field")).alias("fields"))


def document_stats(candidates: DataFrame, posts: DataFrame) -> DataFrame:
    """(query_id, repo, id, length, n, avg_length): a candidate without tokens has length 1 and counts."""
    length = posts.groupBy("query_id", "repo", "id").agg(F.sum("wtf").alias("length"))
    docs = candidates.select("query_id", "repo", "id").join(length, ["query_id", "repo", "id"], "left")
    docs = docs.withColumn("length", F.greatest(F.coalesce("length", F.lit(0.0)), F.lit(1.0)))
    w = Window.partitionBy("query_id")
    return docs.select("*", F.count(F.lit(1)).over(w).alias("n"), F.avg("length").over(w).alias("avg_length"))


def bm25(candidates: DataFrame, queries: DataFrame, posts: DataFrame) -> DataFrame:
    """(query_id, repo, id, raw, score, tokens, fields): the score is relative to the query's best."""
    df = posts.groupBy("query_id", "token").agg(F.count(F.lit(1)).alias("df"))
    wanted = queries.select("query_id", F.explode("tokens").alias("token"))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    tf = F.col("wtf") * (K1 + 1) / (F.col("wtf") + K1 * (1 - B + B * F.col("length") / F.greatest("avg_length", F.lit(1.0))))
    scored = (
        posts.join(sized(wanted), ["query_id", "token"])
        .join(df, ["query_id", "token"])
        .join(document_stats(candidates, posts), ["query_id", "repo", "id"])
        .groupBy("query_id", "repo", "id")
        .agg(F.sum(idf * tf).alias("raw"), F.array_sort(F.collect_set("token")).alias("tokens"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("fields")))).alias("fields"))
        .where("raw > 0")
    )
    best = F.max("raw").over(Window.partitionBy("query_id"))
    return scored.withColumn("score", F.round(F.col("raw") / best, 6))


def ranked(scored: DataFrame, channel: str, reason: Column, score: str = "score", round_after: bool = True) -> DataFrame:
    """Hits (query_id, channel, repo, id, rank, raw_score, reason) of positive score."""
    w = Window.partitionBy("query_id").orderBy(F.desc(score), F.coalesce("repo", F.lit("")), "id")
    value = F.round(score, 6) if round_after else F.col(score)
    return scored.where(F.col(score) > 0).select("query_id", F.lit(channel).alias("channel"), "repo", "id", F.row_number().over(w).alias("rank"), value.alias("raw_score"), reason.alias("reason"))


def lexical_recall(items: DataFrame, queries: DataFrame, limit: int | Limits = 10, domain_terms: Sequence[str] = (), cjk: bool = True) -> DataFrame:
    queries = with_tokens(queries, domain_terms, cjk)
    # both are read several times; they hold no more than the candidates of each query
    candidates = materialize(with_fields(keyword_candidates(items, queries, limit), items), "candidates")
    posts = materialize(postings(spread(candidates), domain_terms, cjk), "postings")
    scored = bm25(candidates, queries, posts)
    reason = F.concat(F.lit("keyword/lexical hit: "), F.array_join(F.slice("tokens", 1, 5), ", "), F.lit(" fields="), F.array_join(F.slice("fields", 1, 5), ","))
    return ranked(scored, "lexical", reason)
