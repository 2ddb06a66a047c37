"""Running golden samples through the engine: all samples in one plan."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import evaluate as E
from tessera.plans.service import Engine
from tessera.plans.tables import materialize


@dataclass
class Report:
    judged: DataFrame
    metrics: DataFrame

    @property
    def passed(self) -> bool:
        return bool(self.metrics.where("sample_group is null and passed").limit(1).count())

    def text(self, fmt: str = "text") -> str:
        return E.render(self.metrics, self.judged, fmt)


def evaluate(engine: Engine, samples: DataFrame, *, repo: str | None = None, commit_sha: str | None = None, top_k: int = E.TOP_K, min_hit_rate: float = E.MIN_HIT_RATE, max_irrelevant: int = E.MAX_IRRELEVANT) -> Report:
    """Build the context of every sample's task, and judge it. Samples are few: their numbers are given on the driver."""
    rows = samples.orderBy("sample_id").collect()
    texts = [engine.request(r.task, "code", {"repo": repo} if repo else None) for r in rows]
    numbered = [(i, r.sample_id, q[1], q[2], None, commit_sha, None, q[-1]) for i, (r, q) in enumerate(zip(rows, texts))]
    spark = samples.sparkSession
    tasks = spark.createDataFrame(numbered, "query_id long, sample_id string, query_text string, repo string, language string, commit_sha string, token_budget int, vector array<double>")
    context = engine.build_contexts(tasks.drop("sample_id"))
    results = context.groups.join(tasks.select("query_id", "sample_id"), "query_id").withColumn("query_id", F.col("sample_id")).drop("sample_id")
    judged = materialize(E.judge(samples, results, top_k), "judged")
    return Report(judged, materialize(E.with_overall(judged, min_hit_rate, max_irrelevant), "metrics"))
