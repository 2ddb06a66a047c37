"""The search and context API: one request or many in one plan."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import context as C
from tessera.operators.fusion import match_reason, recall, rrf, score_parts, stale, trace
from tessera.operators.lexical import Limits
from tessera.operators.vector import Identity, check_dimension
from tessera.plans.tables import materialize
from tessera.sources import aliases as A
from tessera.sources.providers import Provider

QUERY = (
    "query_id long, query_text string, repo string, asset_type string, path_prefix string, language string, symbol_types array<string>, table_name string, commit_sha string, vector array<double>"
)
FILTERS = ("repo", "path_prefix", "language", "symbol_type", "table", "expected_commit_sha")
MOST_RESULTS = 50
PARTS = ("keyword", "lexical", "vector", "symbol", "rrf")


class RequestError(ValueError):
    """A request that cannot be served; code is invalid_request, embedding_unavailable or storage_unavailable."""

    def __init__(self, message: str, code: str = "invalid_request", details: Any = None):
        super().__init__(message)
        self.code, self.details = code, details

    def envelope(self) -> dict:
        return {"error": {"code": self.code, "message": str(self), "details": self.details}}


@dataclass
class Answer:
    """results: the fused top with items; hits and fused: how they came about."""

    results: DataFrame
    hits: DataFrame
    fused: DataFrame
    risks: DataFrame

    def trace(self) -> DataFrame:
        return trace(self.hits)


@dataclass
class Context:
    """groups: results with group and evidence role; risks: missing types and risks of each task; citations."""

    groups: DataFrame
    risks: DataFrame
    citations: DataFrame
    traces: DataFrame = field(repr=False, default=None)


class Engine:
    def __init__(self, items: DataFrame, symbols: DataFrame, embeddings: DataFrame | None = None, *, provider: Provider | None = None, identity: Identity | None = None, aliases: DataFrame | None = None, default_repo: str | None = None, require_repo: bool = False, cjk: bool = True):
        self.spark: SparkSession = items.sparkSession
        self.items, self.symbols, self.embeddings = items, symbols, embeddings
        self.provider, self.identity = provider, provider.identity if provider else identity
        self.aliases, self.terms = aliases, A.terms(aliases) if aliases is not None else []
        self.default_repo, self.require_repo, self.cjk = default_repo, require_repo, cjk

    def _repo(self, repo: str | None) -> str | None:
        repo = repo or self.default_repo
        if not repo and self.require_repo:
            raise RequestError("repo is required")
        return repo

    def _vector(self, text: str, vector: Sequence[float] | None) -> list[float] | None:
        if vector is not None:
            return [float(x) for x in (check_dimension(list(vector), self.identity) if self.identity else vector)]
        if self.provider is None:
            return None
        try:
            return list(self.provider.embed([text])[0])
        except Exception as x:
            raise RequestError(str(x), "embedding_unavailable") from x

    def request(self, text: str, asset_type: str, filters: Mapping[str, Any] | None = None, vector: Sequence[float] | None = None, query_id: int = 0) -> tuple:
        filters = dict(filters or {})
        if not text or not text.strip():
            raise RequestError("query must not be empty")
        if unknown := set(filters) - set(FILTERS):
            raise RequestError("unknown filters", details=sorted(unknown))
        kinds = filters.get("symbol_type")
        kinds = [kinds] if isinstance(kinds, str) else list(kinds) if kinds else None
        text = text.strip()
        return (query_id, text, self._repo(filters.get("repo")), asset_type, filters.get("path_prefix"), filters.get("language"), kinds, filters.get("table"), filters.get("expected_commit_sha"), self._vector(text, vector))

    def search(self, queries: DataFrame, limit: int | Limits = 10) -> Answer:
        """queries: QUERY, any number of rows; all channels and queries run in one plan."""
        if self.aliases is not None:
            queries = A.expanded(queries, self.aliases)
        hits = materialize(recall(self.items, self.embeddings, self.symbols, queries, limit, self.identity, self.terms, self.cjk), "hits")
        fused = match_reason(score_parts(rrf(hits, limit)))
        fused = fused.withColumn("score_parts", F.struct(*PARTS)).drop(*PARTS)
        results = fused.join(self.items, ["repo", "id"])
        old = stale(self.items, queries, hits, self.terms, self.cjk)
        across = results.groupBy("query_id").agg((F.countDistinct("repo") > 1).alias("across"))
        risk = lambda c: F.struct(F.lit(c).alias("code"), F.lit(C.RISK_TEXTS[c]).alias("message"))
        risks = old.join(across, "query_id", "left").select("query_id", "stale", F.array_compact(F.array(F.when(F.col("stale"), risk("STALE_INDEX")), F.when(F.col("across"), risk("CROSS_REPO_RESULTS")))).alias("risks"))
        return Answer(results, hits, fused, risks)

    def _one(self, asset_type: str, text: str, limit: int, filters: Mapping[str, Any] | None, vector: Sequence[float] | None) -> Answer:
        if not isinstance(limit, int) or isinstance(limit, bool) or not 1 <= limit <= MOST_RESULTS:
            raise RequestError(f"limit must be from 1 to {MOST_RESULTS}")
        row = self.request(text, asset_type, filters, vector)
        try:
            return self.search(self.spark.createDataFrame([row], QUERY), limit)
        except (PySparkException, Py4JJavaError) as x:
            raise RequestError("the stored tables cannot be read", "storage_unavailable", type(x).__name__) from x

    def search_code(self, text: str, limit: int = 10, filters: Mapping[str, Any] | None = None, vector: Sequence[float] | None = None) -> Answer:
        return self._one("code", text, limit, filters, vector)

    def search_db_schema(self, text: str, limit: int = 10, filters: Mapping[str, Any] | None = None, vector: Sequence[float] | None = None) -> Answer:
        return self._one("db_schema", text, limit, filters, vector)

    def search_doc(self, text: str, limit: int = 10, filters: Mapping[str, Any] | None = None, vector: Sequence[float] | None = None) -> Answer:
        return self._one("doc", text, limit, filters, vector)

    def build_contexts(self, tasks: DataFrame, sizes: Mapping[str, int] | None = None) -> Context:
        """tasks: query_id, query_text, repo, language, commit_sha, token_budget (null: none), vector. The four searches of all tasks are one plan."""
        sizes = {**C.SIZES, **(sizes or {})}
        # one request for each task and group: their key is query_id * 4 + the group's place
        count = len(C.BUDGET_ORDER)
        null = lambda t: F.lit(None).cast(t)
        asset = lambda g: C.ASSETS[g]
        groups = F.array(*[F.struct(F.lit(i).alias("at"), F.lit(asset(g)).alias("asset_type"), F.lit(asset(g) == "code").alias("code"), F.lit(g == "similar_implementations").alias("similar")) for i, g in enumerate(C.BUDGET_ORDER)])
        q = tasks.withColumn("g", F.explode(groups))
        q = q.select(
            (F.col("query_id") * count + F.col("g.at")).alias("query_id"), "query_text", "repo", "g.asset_type", null("string").alias("path_prefix"), F.when(F.col("g.code"), F.col("language")).alias("language"),
            F.when(F.col("g.similar"), F.array(F.lit("method"), F.lit("class"))).alias("symbol_types"), null("string").alias("table_name"), "commit_sha", "vector",
        )
        at = F.pmod(F.col("query_id"), F.lit(count)).cast("int")
        answer = self.search(q, Limits(F.array(*[F.lit(sizes[g]) for g in C.BUDGET_ORDER])[at], max(sizes.values())))
        task, name = F.floor(F.col("query_id") / count).cast("long"), F.array(*map(F.lit, C.BUDGET_ORDER))[at]
        rows = answer.results.withColumn("group", name).withColumn("query_id", task)
        results = materialize(C.with_cost(C.dedupe(rows)), "results")
        kept = materialize(C.within_budget(results, tasks), "kept")
        stale_any = answer.risks.select(task.alias("query_id"), "stale").groupBy("query_id").agg(F.max("stale").alias("stale"))
        hits = answer.hits.withColumn("group", name).withColumn("query_id", task)
        return Context(kept, C.risks(kept, tasks, stale_any), C.citations(kept), hits)

    def build_task_context(self, task: str, *, repo: str | None = None, language: str | None = None, expected_commit_sha: str | None = None, token_budget: int | None = None, sizes: Mapping[str, int] | None = None) -> Context:
        if token_budget is not None and (not isinstance(token_budget, int) or isinstance(token_budget, bool) or token_budget <= 0):
            raise RequestError("token_budget must be a positive integer")
        if not task or not task.strip():
            raise RequestError("task must not be empty")
        row = (0, task.strip(), self._repo(repo), language, expected_commit_sha, token_budget, self._vector(task.strip(), None))
        tasks = self.spark.createDataFrame([row], "query_id long, query_text string, repo string, language string, commit_sha string, token_budget int, vector array<double>")
        return self.build_contexts(tasks, sizes)
