"""The vector channel: exact cosine within one space (provider, model, dimension)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.lexical import Limits, ranked, scoped, within


@dataclass(frozen=True)
class Identity:
    """A vector space; only equal ones may be compared."""

    provider: str
    model: str
    dimension: int


class DimensionError(ValueError):
    pass


def manual_identity(dimension: int) -> Identity:
    return Identity("manual", f"dimension-{dimension}", dimension)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column, na: Column | None = None, nb: Column | None = None) -> Column:
    """Cosine, at least 0; 0 for null, empty, zero or unequally long vectors."""
    na = F.sqrt(dot(a, a)) if na is None else na
    nb = F.sqrt(dot(b, b)) if nb is None else nb
    ok = (F.size(a) == F.size(b)) & (F.size(a) > 0) & (na > 0) & (nb > 0)
    return F.coalesce(F.when(ok, F.greatest(F.lit(0.0), dot(a, b) / (na * nb))), F.lit(0.0))


def distance_score(distance: Column) -> Column:
    return F.coalesce(F.round(F.greatest(F.lit(0.0), 1 - distance), 6), F.lit(0.0))


def in_space(embeddings: DataFrame, identity: Identity) -> DataFrame:
    """The space's vectors of the right length."""
    return embeddings.where((F.col("provider") == identity.provider) & (F.col("model") == identity.model) & (F.col("dimension") == identity.dimension)).where(F.size("embedding") == identity.dimension)


def check_dimension(vector: list[float], identity: Identity) -> list[float]:
    if len(vector) != identity.dimension:
        raise DimensionError(f"query vector of {len(vector)} for {identity.provider}/{identity.model} of {identity.dimension}")
    return vector


def first_embedding(items: DataFrame, embeddings: DataFrame) -> DataFrame:
    """items with their first vector by (provider, model, dimension), null where there is none."""
    w = Window.partitionBy("repo", "item_id").orderBy("provider", "model", "dimension", "vec_id" if "vec_id" in embeddings.columns else F.lit(0))
    first = embeddings.withColumn("k", F.row_number().over(w)).where("k = 1").select("repo", F.col("item_id").alias("id"), "provider", "model", "dimension", "embedding")
    return items.join(first, ["repo", "id"], "left")


def vector_scores(items: DataFrame, embeddings: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, repo, id, score) of all items within each query's filters that have a vector; queries with a column vector.

    Candidates go by their vectors only: the texts stay where they are.
    """
    narrow = [c for c in ("repo", "id", "asset_type", "path", "language", "symbol_type", "table_name", "commit_sha") if c in items.columns]
    vectors = embeddings.select("repo", F.col("item_id").alias("id"), F.col("embedding").cast("array<double>").alias("embedding")).withColumn("norm", F.sqrt(dot(F.col("embedding"), F.col("embedding"))))
    asked = queries.where("vector is not null").withColumn("norm", F.sqrt(dot(F.col("vector"), F.col("vector"))))
    rows = scoped(items.select(*narrow).join(vectors, ["repo", "id"]), asked)
    return rows.select("query_id", "repo", "id", cosine(F.col("embedding"), F.col("q_vector"), F.col("norm"), F.col("q_norm")).alias("score"))


def vector_recall(items: DataFrame, embeddings: DataFrame, queries: DataFrame, limit: int | Limits = 10, identity: Identity | None = None) -> DataFrame:
    """Hits of the vector channel; without an identity every item counts with its first vector, without a cap."""
    reason = F.lit("vector similarity hit")
    if identity is None:
        first = first_embedding(items.select("repo", "id"), embeddings).where("embedding is not null").select("repo", F.col("id").alias("item_id"), "embedding")
        return ranked(vector_scores(items, first, queries), "vector", reason)
    scored = vector_scores(items, in_space(embeddings, identity), queries).withColumn("score", F.round("score", 6)).where("score > 0")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id", "repo")
    return ranked(within(scored.withColumn("k", F.row_number().over(w)), "k", limit, True), "vector", reason)
