"""A log of calls as JSON lines, and reading it back as a table."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Mapping
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "call_id string, tool string, ok boolean, elapsed_ms double, error string, arguments string, results long, keys array<string>, payload string"


class CallLog:
    """Failing to write the log never fails a call."""

    def __init__(self, path: str | Path, payloads: bool = False):
        self.path, self.payloads = Path(path), payloads

    def call(self, tool: str, arguments: Mapping[str, Any], run: Callable[[], Mapping[str, Any]]) -> Mapping[str, Any]:
        event = {"call_id": str(uuid.uuid4()), "tool": tool, "arguments": json.dumps(arguments if self.payloads else sorted(arguments), ensure_ascii=False, default=str)}
        began = time.perf_counter()
        try:
            answer = run()
        except Exception as x:
            self._write(event | {"ok": False, "error": f"{getattr(x, 'code', type(x).__name__)}: {x}", "elapsed_ms": _since(began)})
            raise
        found = answer.get("results")
        more = {"payload": json.dumps(answer, ensure_ascii=False, default=str)} if self.payloads else {}
        self._write(event | more | {"ok": True, "elapsed_ms": _since(began), "keys": sorted(answer), "results": len(found) if isinstance(found, list) else None})
        return answer

    def _write(self, event: Mapping[str, Any]) -> None:
        try:
            with self.path.open("a", encoding="utf-8", newline="\n") as f:
                f.write(json.dumps(event, ensure_ascii=False, sort_keys=True) + "\n")
        except OSError:
            pass


def _since(began: float) -> float:
    return round((time.perf_counter() - began) * 1000, 2)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).json(path)
