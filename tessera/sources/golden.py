"""Golden samples from JSON."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import DataFrame, SparkSession

HIT = ("source_type", "path", "symbol", "table", "column", "heading_path")
SCHEMA = "sample_group string, sample_id string, task string, expected_hits array<struct<source_type:string,path:string,symbol:string,table_name:string,column_name:string,heading_path:string>>, irrelevant_ids array<string>"


def from_mapping(spark: SparkSession, raw: Any) -> DataFrame:
    """Checked samples; groups without samples are left out."""
    if not isinstance(raw, dict) or raw.get("schema_version") != 1:
        raise ValueError("schema_version must be 1")
    groups = raw.get("groups")
    if not isinstance(groups, dict):
        raise ValueError("groups must be an object")
    rows, seen = [], set()
    for name, group in groups.items():
        samples = group.get("samples") if isinstance(group, dict) else None
        if not isinstance(samples, list):
            raise ValueError(f"group {name} has no list of samples")
        for i, x in enumerate(samples):
            where = f"sample {i + 1} of group {name}"
            if not isinstance(x, dict) or not isinstance(x.get("id"), str) or not x["id"]:
                raise ValueError(f"{where} has no id")
            if x["id"] in seen:
                raise ValueError(f"sample {x['id']} is there twice")
            seen.add(x["id"])
            if not x.get("task") or not isinstance(x.get("expected_hits"), list) or not x["expected_hits"]:
                raise ValueError(f"sample {x['id']} needs a task and expected hits")
            for h in x["expected_hits"]:
                if not isinstance(h, dict) or set(h) - set(HIT) or not h.get("source_type"):
                    raise ValueError(f"sample {x['id']} has an expected hit of another shape")
            rows.append((name, x["id"], x["task"], [tuple(h.get(k) for k in HIT) for h in x["expected_hits"]], list(x.get("irrelevant_result_ids", []))))
    return spark.createDataFrame(rows, SCHEMA)


def from_file(spark: SparkSession, path: str) -> DataFrame:
    text = "\n".join(r.value for r in spark.read.text(path, wholetext=True).collect())
    return from_mapping(spark, json.loads(text))
