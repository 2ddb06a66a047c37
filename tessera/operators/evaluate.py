"""Retrieval quality over golden samples: hit@k, reciprocal rank, irrelevant results, source completeness."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.context import BUDGET_ORDER, order_of

# The thresholds of the quality gate.
MIN_HIT_RATE, TOP_K, MAX_IRRELEVANT = 0.7, 5, 3
GROUP_OF = {"code": "related_code", "db_schema": "related_db_schema", "doc": "related_docs"}
EXPECTED = ("source_type", "path", "symbol", "table_name", "column_name", "heading_path")


def matches(expected: Column, columns: tuple[str, ...] = EXPECTED) -> Column:
    """Whether a result's source has every value the expected hit names."""
    out = F.lit(True)
    for c in columns:
        out = out & (expected[c].isNull() | F.coalesce(expected[c] == F.col(c), F.lit(False)))
    return out


def sample_results(samples: DataFrame, results: DataFrame) -> DataFrame:
    """Each sample's results in the order they are judged in, place from 1.

    samples: sample_group, sample_id, expected_hits (array of EXPECTED structs),
    irrelevant_ids. A sample that expects one asset type is judged within that
    type's group, others over all groups.
    """
    types = F.array_distinct(F.transform("expected_hits", lambda h: h["source_type"]))
    only = F.when(F.size(types) == 1, F.create_map(*[F.lit(x) for p in GROUP_OF.items() for x in p])[types[0]])
    rows = samples.withColumn("only", only).join(results.withColumnRenamed("query_id", "sample_id"), "sample_id")
    rows = rows.where(F.col("only").isNull() | (F.col("group") == F.col("only")))
    w = Window.partitionBy("sample_id").orderBy(order_of(BUDGET_ORDER), "rank")
    return rows.withColumn("place", F.row_number().over(w))


def judge(samples: DataFrame, results: DataFrame, top_k: int = TOP_K) -> DataFrame:
    """One row for each sample: first_rank (null: missed), irrelevant, returned, sourced, hit, failed. Samples without results are misses."""
    rows = sample_results(samples, results)
    hit = F.exists("expected_hits", lambda h: matches(h))
    per = rows.groupBy("sample_id").agg(
        F.min(F.when(hit & (F.col("place") <= top_k), F.col("place"))).alias("first_rank"),
        F.count_if((F.col("place") <= 2 * top_k) & F.array_contains("irrelevant_ids", F.coalesce("id", F.lit("<unknown>")))).alias("irrelevant"),
        F.count(F.lit(1)).alias("returned"),
        F.count("source_type").alias("sourced"),
    )
    df = samples.select("sample_group", "sample_id").join(per, "sample_id", "left").fillna(0, ["irrelevant", "returned", "sourced"])
    df = df.withColumn("hit", F.col("first_rank").isNotNull())
    return df.withColumn("failed", ~F.col("hit") | (F.col("sourced") < F.col("returned")))


def _metrics(df) -> DataFrame:
    returned = F.sum("returned")
    return df.agg(
        F.count(F.lit(1)).alias("samples"),
        F.count_if("hit").alias("hits"),
        F.avg(F.col("hit").cast("int")).alias("rate"),
        F.round(F.sum(F.coalesce(1 / F.col("first_rank"), F.lit(0.0))) / F.count(F.lit(1)), 4).alias("mrr"),
        F.sum("irrelevant").alias("irrelevant"),
        F.when(returned > 0, F.sum("sourced") / returned).otherwise(1.0).alias("complete"),
        F.array_sort(F.collect_list(F.when(F.col("failed"), F.col("sample_id")))).alias("failed_ids"),
    )


def _passed(df: DataFrame, min_hit_rate: float, max_irrelevant: int) -> DataFrame:
    passed = (F.col("rate") >= min_hit_rate) & (F.col("irrelevant") <= max_irrelevant) & (F.col("complete") == 1) & (F.size("failed_ids") == 0)
    return df.withColumn("passed", passed).withColumn("hit_rate", F.round("rate", 4)).withColumn("completeness", F.round("complete", 4)).drop("rate", "complete")


def by_group(judged: DataFrame, min_hit_rate: float = MIN_HIT_RATE, max_irrelevant: int = MAX_IRRELEVANT) -> DataFrame:
    return _passed(_metrics(judged.groupBy("sample_group")), min_hit_rate, max_irrelevant)


def with_overall(judged: DataFrame, min_hit_rate: float = MIN_HIT_RATE, max_irrelevant: int = MAX_IRRELEVANT) -> DataFrame:
    """Metrics of each group and, with sample_group null, over all; all passes if every group does."""
    df = _passed(_metrics(judged.rollup("sample_group")), min_hit_rate, max_irrelevant)
    every = F.min(F.when(F.col("sample_group").isNotNull(), F.col("passed"))).over(Window.partitionBy(F.lit(1)))
    return df.withColumn("passed", F.when(F.col("sample_group").isNull(), every).otherwise(F.col("passed")))


def render(metrics: DataFrame, judged: DataFrame | None = None, fmt: str = "text") -> str:
    """A report of with_overall's rows (one for each group, few), as text, markdown or json."""
    rows = sorted((r.asDict(recursive=True) for r in metrics.collect()), key=lambda r: (r["sample_group"] is None, r["sample_group"] or ""))
    details = [r.asDict() for r in judged.orderBy("sample_id").collect()] if judged is not None else []
    if fmt == "json":
        return json.dumps({"groups": {r.pop("sample_group") or "_summary": r for r in rows}, "samples": details}, ensure_ascii=False, indent=2)
    if fmt not in ("text", "markdown"):
        raise ValueError(f"unknown format {fmt}")
    head = ("Group", "Passed", "Hit rate", "MRR", "Irrelevant", "Completeness", "Failed samples")
    body = [(r["sample_group"] or "all", "YES" if r["passed"] else "NO", f"{r['hit_rate']} ({r['hits']}/{r['samples']})", str(r["mrr"]), str(r["irrelevant"]), str(r["completeness"]), ", ".join(r["failed_ids"])) for r in rows]
    marks = [(d["sample_id"], "HIT" if d["hit"] else "MISS", str(d["first_rank"] or "-")) for d in details]
    if fmt == "markdown":
        line = lambda cells: f"| {' | '.join(cells)} |"
        out = ["# Evaluation report", "", line(head), line(["---"] * len(head)), *map(line, body)]
        return "\n".join(out + (["", line(("Sample", "Result", "First rank")), line(["---"] * 3), *map(line, marks)] if marks else []))
    width = [max(map(len, col)) for col in zip(head, *body)]
    lines = ["  ".join(c.ljust(w) for c, w in zip(cells, width)).rstrip() for cells in (head, *body)]
    return "\n".join([*lines, *(f"[{r}] {s} (first rank {k})" for s, r, k in marks)])
