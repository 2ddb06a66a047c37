"""Domain vocabulary: terms and what they expand to."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.lexical import sized

SCHEMA = "term string, expands_to array<string>"


def from_mapping(spark: SparkSession, raw: Any) -> DataFrame:
    """Checked aliases; blank terms and expansions are dropped."""
    if not isinstance(raw, dict):
        raise ValueError("the alias file must hold an object")
    entries = raw.get("aliases", [])
    if not isinstance(entries, list) or not all(isinstance(x, dict) for x in entries):
        raise ValueError("aliases must be a list of objects")
    rows = []
    for x in entries:
        if not isinstance(x.get("expands_to", []), list):
            raise ValueError("expands_to must be a list")
        term, to = str(x.get("term", "")).strip(), [v for y in x.get("expands_to", []) if (v := str(y).strip())]
        if term and to:
            rows.append((term, to))
    return spark.createDataFrame(rows, SCHEMA)


def from_file(spark: SparkSession, path: str) -> DataFrame:
    import json

    text = "\n".join(r.value for r in spark.read.text(path, wholetext=True).collect())
    return from_mapping(spark, json.loads(text))


def terms(aliases: DataFrame) -> list[str]:
    """All terms and expansions, for the tokeniser."""
    rows = aliases.select(F.explode(F.concat(F.array("term"), "expands_to")).alias("t")).distinct().orderBy("t")
    return [r.t for r in rows.collect()]


def matched(queries: DataFrame, aliases: DataFrame) -> DataFrame:
    """(query_id, term, expands_to): the aliases whose term or an expansion the query holds, in any letter case."""
    text = F.lower("query_text")
    hit = F.contains(text, F.lower("term")) | F.exists("expands_to", lambda x: F.contains(text, F.lower(x)))
    return queries.join(sized(aliases), hit).select("query_id", "term", "expands_to")


def expanded(queries: DataFrame, aliases: DataFrame) -> DataFrame:
    """queries with the matched terms and expansions behind their text, and labels `term -> a, b`."""
    more = matched(queries, aliases).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("term", "expands_to"))).alias("m"))
    added = F.array_join(F.flatten(F.transform("m", lambda x: F.concat(F.array(x["term"]), x["expands_to"]))), " ")
    labels = F.transform("m", lambda x: F.concat(x["term"], F.lit(" -> "), F.array_join(x["expands_to"], ", ")))
    return queries.join(more, "query_id", "left").withColumn("query_text", F.concat_ws(" ", "query_text", added)).withColumn("aliases", F.coalesce(labels, F.array().cast("array<string>"))).drop("m")
