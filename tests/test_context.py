import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import context as C
from tessera.operators import evaluate as E
from tessera.plans.service import RequestError
from tessera.sources import golden
from tests.test_search import REPO, engine, item, items, seed


def test_task_context(spark):
    data = seed(spark).withColumn("file_hash", F.lit("h")).withColumn("indexed_at", F.current_timestamp())
    c = engine(spark, data).build_task_context("tide gauge mooring watch", repo=REPO)
    rows = {r.id: (r.group, r.evidence_role) for r in c.groups.collect()}
    assert rows["code:TideGauge.level"] == ("related_code", "primary") and rows["doc:Night Watch"] == ("related_docs", "background")
    assert not any(g == "similar_implementations" for g, _ in rows.values())
    risk = c.risks.first()
    assert risk.missing == [] and risk.risks == [] and c.citations.count() == len(rows)
    assert C.uncited(c.groups, c.citations).count() == 0


def test_foreign_repo_and_tiny_budget(spark):
    e = engine(spark, seed(spark))
    assert e.build_task_context("tide", repo="elsewhere").risks.first().missing == ["code", "db_schema", "doc"]
    c = e.build_task_context("tide gauge", repo=REPO, token_budget=1)
    assert [r.group for r in c.groups.collect()] == ["related_code"] and c.citations.count() == 1
    risk = c.risks.first()
    assert risk.missing == ["db_schema", "doc"] and [r.code for r in risk.risks] == ["MISSING_CONTEXT", "MISSING_CONTEXT", "INCOMPLETE_PROVENANCE"]
    for bad in ("small", 0, True):
        with pytest.raises(RequestError):
            e.build_task_context("x", repo=REPO, token_budget=bad)


def fold(budget, costs):
    left, kept = budget, []
    for i, c in enumerate(costs):
        if i == 0 or c <= left:
            kept.append(i)
            left = max(0, left - c)
    return kept


def test_budget_equals_a_plain_fold(spark):
    rng, rows, budgets, want = random.Random(1), [], [], {}
    for q in range(60):
        costs = {g: [rng.randint(1, 40) for _ in range(rng.randint(0, 4))] for g in C.BUDGET_ORDER}
        budget = rng.choice([None, 0, 1, 30, 60, 90])
        flat = [(g, i + 1, c) for g in C.BUDGET_ORDER for i, c in enumerate(costs[g])]
        rows += [(q, g, r, c) for g, r, c in flat]
        budgets.append((q, budget))
        keep = range(len(flat)) if budget is None else [] if budget <= 0 else fold(budget, [c for _, _, c in flat])
        want |= {(q, *flat[i][:2]): 1 for i in keep}
    df = spark.createDataFrame(rows, "query_id long, group string, rank int, cost int")
    got = C.within_budget(df, spark.createDataFrame(budgets, "query_id long, token_budget int")).collect()
    assert {(r.query_id, r.group, r.rank) for r in got} == set(want)


def test_low_confidence(spark):
    data = items(spark, item("a", "x", file_hash="h"))
    rows = data.withColumns({"query_id": F.lit(1).cast("long"), "group": F.lit("related_code"), "rank": F.lit(1), "score": F.lit(0.009)})
    stale = spark.createDataFrame([(1, True)], "query_id long, stale boolean")
    assert [r.code for r in C.risks(rows, stale, stale).first().risks] == ["MISSING_CONTEXT", "MISSING_CONTEXT", "LOW_CONFIDENCE", "INCOMPLETE_PROVENANCE", "STALE_INDEX"]


def results(spark, rows):
    return spark.createDataFrame(rows, "query_id string, group string, rank int, id string, source_type string, path string, symbol string, table_name string, column_name string, heading_path string")


def sample(group, id, irrelevant=(), **hit):
    return {"id": id, "task": "t", "expected_hits": [{"source_type": "code", **hit}], "irrelevant_result_ids": list(irrelevant)}


def test_metrics_by_hand(spark):
    raw = {"schema_version": 1, "groups": {"g": {"samples": [sample("g", "a", path="p1"), sample("g", "b", path="p3", irrelevant=["i2"])]}, "h": {"samples": [sample("h", "c", path="nowhere")]}, "none": {"samples": []}}}
    rows = [(s, "related_code", k, f"i{k}", "code", f"p{k}", None, None, None, None) for s in "abc" for k in range(1, 8)] + [("a", "related_docs", 1, "d", "doc", "p1", None, None, None, None)]
    judged = E.judge(golden.from_mapping(spark, raw), results(spark, rows), 3)
    assert {r.sample_id: (r.first_rank, r.irrelevant) for r in judged.collect()} == {"a": (1, 0), "b": (3, 1), "c": (None, 0)}
    m = {r.sample_group: r for r in E.with_overall(judged).collect()}
    assert (m[None].mrr, m[None].hit_rate, m[None].passed, m[None].failed_ids) == (0.4444, 0.6667, False, ["c"]) and m["g"].passed and not m["h"].passed
    # rank 4 is beyond 3, a single type is judged in its own group
    assert E.judge(golden.from_mapping(spark, {"schema_version": 1, "groups": {"g": {"samples": [sample("g", "a", path="p4")]}}}), results(spark, rows), 3).first().first_rank is None
    for fmt, part in (("text", "[MISS] c"), ("markdown", "| g | YES |"), ("json", '"_summary"')):
        assert part in E.render(E.with_overall(judged), judged, fmt)
    with pytest.raises(ValueError):
        E.render(E.with_overall(judged), fmt="xml")


def test_samples_without_results(spark):
    samples = golden.from_mapping(spark, {"schema_version": 1, "groups": {"g": {"samples": [sample("g", "a", path="p")]}}})
    r = E.with_overall(E.judge(samples, results(spark, []))).where("sample_group is null").first()
    assert (r.completeness, r.hit_rate, r.passed) == (1.0, 0.0, False)


@pytest.mark.parametrize("raw", [{}, {"schema_version": 2}, {"schema_version": 1, "groups": []}, {"schema_version": 1, "groups": {"g": {}}}, {"schema_version": 1, "groups": {"g": {"samples": [{"id": "a"}]}}}, {"schema_version": 1, "groups": {"g": {"samples": [sample("g", "a"), sample("g", "a")]}}}])
def test_bad_golden_files(spark, raw):
    with pytest.raises(ValueError):
        golden.from_mapping(spark, raw)
