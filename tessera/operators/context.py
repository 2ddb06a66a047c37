"""Composing a task's context: de-duplication, token budget, gaps, risks and citations.

Relations are keyed by query_id. results: query_id, group, rank, score,
match_reason and the item's columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import token_cost

# The groups, the orders they are read in, their roles and sizes, and the risk texts.
DEDUPE_ORDER = ("related_code", "related_db_schema", "similar_implementations", "related_docs")
BUDGET_ORDER = ("related_code", "related_db_schema", "related_docs", "similar_implementations")
ROLES = {"related_code": "primary", "related_db_schema": "primary", "similar_implementations": "related", "related_docs": "background"}
SIZES = {"related_code": 8, "related_db_schema": 5, "related_docs": 5, "similar_implementations": 5}
ASSETS = {"related_code": "code", "related_db_schema": "db_schema", "related_docs": "doc", "similar_implementations": "code"}
REQUIRED = ("code", "db_schema", "doc")
LOW_SCORE = 0.01
RISK_TEXTS = {
    "LOW_CONFIDENCE": "召回结果整体置信度较低，建议扩大检索或补充关键词。",
    "INCOMPLETE_PROVENANCE": "部分上下文缺少 file_hash 或 indexed_at，无法完整判断索引新鲜度。",
    "STALE_INDEX": "存在不匹配指定 commit 的候选，已严格排除。",
    "CROSS_REPO_RESULTS": "结果来自多个 repo，需要确认跨仓上下文是否符合任务边界。",
}
MISSING_TEXT = "未召回到 {} 上下文，需要人工确认。"
SOURCE = (
    "source_type", "repo", "branch", "commit_sha", "file_hash", "indexed_at", "index_batch_id", "path", "start_line", "end_line", "symbol", "table_name", "column_name", "heading_path",
)


def source(columns: tuple[str, ...] = SOURCE) -> Column:
    """The whole source record; two results of one record are one."""
    return F.struct(*columns)


def order_of(groups: tuple[str, ...]) -> Column:
    return F.array_position(F.array(*map(F.lit, groups)), F.col("group"))


def dedupe(results: DataFrame) -> DataFrame:
    """Each source once for each query, in its first group, with the group's evidence role."""
    w = Window.partitionBy("query_id", *SOURCE).orderBy(order_of(DEDUPE_ORDER), "rank")
    role = F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair])[F.col("group")]
    return results.withColumn("k", F.row_number().over(w)).where("k = 1").drop("k").withColumn("evidence_role", role)


def with_cost(results: DataFrame) -> DataFrame:
    return results.withColumn("cost", token_cost(*[F.col(c) for c in ("title", "summary", "content", "match_reason")]))


def within_budget(results: DataFrame, budgets: DataFrame) -> DataFrame:
    """The results kept within each query's token_budget (null: all; 0 or less: none).

    The first result is always kept, and uses up the budget if it exceeds it;
    each later one is kept if it fits in what is left.
    """
    place = F.struct(order_of(BUDGET_ORDER).alias("at"), F.col("rank").alias("rank"), F.col("cost").alias("cost"), F.col("group").alias("group"))
    lists = results.groupBy("query_id").agg(F.array_sort(F.collect_list(place)).alias("all")).join(budgets.select("query_id", "token_budget"), "query_id", "left")
    empty = F.array().cast("array<struct<group:string,rank:int>>")
    start = F.struct(F.col("token_budget").cast("long").alias("left"), F.lit(True).alias("first"), empty.alias("kept"))

    def step(a: Column, x: Column) -> Column:
        keep = a["first"] | (x["cost"] <= a["left"])
        left = F.when(keep, F.greatest(F.lit(0), a["left"] - x["cost"])).otherwise(a["left"])
        entry = F.array(F.struct(x["group"].alias("group"), x["rank"].cast("int").alias("rank")))
        return F.struct(left.cast("long").alias("left"), F.lit(False).alias("first"), F.when(keep, F.concat(a["kept"], entry)).otherwise(a["kept"]).alias("kept"))

    folded = F.aggregate("all", start, step)["kept"]
    everything = F.transform("all", lambda x: F.struct(x["group"].alias("group"), x["rank"].cast("int").alias("rank")))
    kept = F.when(F.col("token_budget").isNull(), everything).when(F.col("token_budget") <= 0, empty).otherwise(folded)
    kept = lists.select("query_id", F.explode(kept).alias("x")).select("query_id", "x.group", "x.rank")
    return results.join(kept, ["query_id", "group", "rank"], "left_semi")


def missing(results: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, missing): the required asset types without a result; similar implementations don't count."""
    asset = F.create_map(*[F.lit(x) for pair in ASSETS.items() for x in pair])[F.col("group")]
    found = results.where("group <> 'similar_implementations'").groupBy("query_id").agg(F.collect_set(asset).alias("found"))
    none = F.array().cast("array<string>")
    return queries.select("query_id").join(found, "query_id", "left").select("query_id", F.array_except(F.array(*map(F.lit, REQUIRED)), F.coalesce("found", none)).alias("missing"))


def incomplete_provenance(results: DataFrame) -> DataFrame:
    """(query_id, incomplete): whether code or documents lack a file hash or time."""
    lacks = F.col("source_type").isin("code", "doc") & ((F.coalesce("file_hash", F.lit("")) == "") | F.col("indexed_at").isNull())
    return results.groupBy("query_id").agg(F.max(lacks).alias("incomplete"))


def risks(results: DataFrame, queries: DataFrame, stale: DataFrame) -> DataFrame:
    """(query_id, missing, risks): an array of code and message, in a fixed order."""
    counted = results.where("group <> 'similar_implementations'")
    low = counted.groupBy("query_id").agg((F.max("score") < LOW_SCORE).alias("low"))
    df = missing(results, queries).join(low, "query_id", "left").join(incomplete_provenance(counted), "query_id", "left").join(stale, "query_id", "left")
    risk = lambda code: F.struct(F.lit(code).alias("code"), F.lit(RISK_TEXTS[code]).alias("message"))
    before, after = MISSING_TEXT.split("{}")
    gaps = F.transform("missing", lambda m: F.struct(F.lit("MISSING_CONTEXT").alias("code"), F.concat(F.lit(before), m, F.lit(after)).alias("message")))
    rest = F.array_compact(F.array(*[F.when(F.col(c), risk(code)) for c, code in (("low", "LOW_CONFIDENCE"), ("incomplete", "INCOMPLETE_PROVENANCE"), ("stale", "STALE_INDEX"))]))
    return df.select("query_id", "missing", F.concat(gaps, rest).alias("risks"))


def citations(results: DataFrame) -> DataFrame:
    """Each source of a query's results once, at its first place in the order of the groups."""
    w = Window.partitionBy("query_id", *SOURCE).orderBy(order_of(BUDGET_ORDER), "rank")
    first = results.withColumn("k", F.row_number().over(w)).where("k = 1")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(order_of(BUDGET_ORDER), "rank"))
    return first.select("query_id", place.alias("place"), *SOURCE)


def uncited(results: DataFrame, cited: DataFrame) -> DataFrame:
    """Results whose source is not cited; there should be none."""
    cond = [results["query_id"] == cited["query_id"], *[results[c].eqNullSafe(cited[c]) for c in SOURCE]]
    return results.join(cited, cond, "left_anti")
