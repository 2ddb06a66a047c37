import io
import json

import pytest

from tessera.__main__ import main
from tessera.plans import calls
from tessera.plans.evaluation import evaluate
from tessera.plans.service import RequestError
from tessera.sources import golden
from tests.test_context import sample
from tests.test_search import REPO, engine, item, items
from tests.test_sources import tree  # noqa: F401


def test_index_search_and_eval(spark, tree, tmp_path, capsys):  # noqa: F811
    store = f"file://{tmp_path}/store"

    def run(*args):
        out = io.StringIO()
        return main([*args, "--store", store], out, {}, spark), out.getvalue()

    code, text = run("index", "--root", str(tree), "--repo", "r")
    assert code == 0 and json.loads(text)["items_written"] == 7
    code, text = run("search", "tide gauge level", "--repo", "r")
    assert code == 0 and "TideGauge" in json.loads(text.splitlines()[0])["id"]
    tasks = tmp_path / "tasks.json"
    tasks.write_text(json.dumps({"schema_version": 1, "groups": {"g": {"samples": [sample("g", "a", path="src/harbour/TideGauge.java") | {"task": "tide gauge level"}]}}}))
    assert run("eval", "--tasks", str(tasks), "--validate-only") == (0, f"valid: {tasks} (1 groups, 1 samples)\n")
    code, text = run("eval", "--tasks", str(tasks), "--repo", "r", "--format", "json")
    assert code == 0 and json.loads(text)["groups"]["_summary"]["hit_rate"] == 1.0
    tasks.write_text("{}")
    assert run("eval", "--tasks", str(tasks))[0] == 2 and "schema_version" in capsys.readouterr().err
    assert run("index", "--root", str(tree), "--with-embedding")[0] == 2
    (tree / "docs/bad.md").write_bytes(b"\xff")
    assert run("index", "--root", str(tree), "--repo", "r", "--dry-run")[0] == 1


CORPUS = [
    ("code", "OrderService.create"), ("code", "OrderService.cancel"), ("code", "RefundHandler.handle"), ("code", "RopeCounter.count"), ("code", "LedgerExporter.export"), ("code", "AuditTrail.append"),
    ("db_schema", "order_header"), ("db_schema", "refund_request"), ("db_schema", "ledger_entry"), ("db_schema", "audit_event"), ("doc", "Refund rules"), ("doc", "Ledger export"), ("doc", "Audit guide"), ("doc", "Order states"),
]
TASKS = [
    ("code", "cancel an order in OrderService", "OrderService.cancel"), ("code", "who handles a refund", "RefundHandler.handle"), ("code", "count the rope", "RopeCounter.count"), ("code", "append to the audit trail", "AuditTrail.append"),
    ("db_schema", "columns of the refund request table", "refund_request"), ("db_schema", "ledger entry table", "ledger_entry"), ("db_schema", "audit event table", "audit_event"), ("doc", "rules for a refund", "Refund rules"), ("doc", "how the ledger is exported", "Ledger export"), ("doc", "states of an order", "Order states"),
]


def test_quality_gate(spark):
    """A corpus of 14 items and 10 samples: each is hit in the first five."""
    from pyspark.sql import functions as F

    data = items(spark, *[item(f"{kind}:{title}", title, title.replace(".", " ").replace("_", " "), kind, file_hash="h") for kind, title in CORPUS]).withColumn("indexed_at", F.current_timestamp())
    field = {"code": "symbol", "db_schema": "table", "doc": "heading_path"}
    raw = {"schema_version": 1, "groups": {kind: {"samples": [{"id": f"{kind}{i}", "task": task, "expected_hits": [{"source_type": kind, field[kind]: title}]} for i, (k, task, title) in enumerate(TASKS) if k == kind]} for kind in field}}
    report = evaluate(engine(spark, data), golden.from_mapping(spark, raw), repo=REPO)
    rows = {r.sample_group: r for r in report.metrics.collect()}
    assert rows[None].hit_rate == 1.0 and rows[None].completeness == 1.0 and rows[None].samples == 10 and report.passed and "all" in report.text()


def test_call_log(spark, tmp_path):
    log = calls.CallLog(tmp_path / "calls.jsonl")
    assert log.call("search_code", {"query": "secret"}, lambda: {"results": [1, 2]}) == {"results": [1, 2]}
    calls.CallLog(tmp_path / "calls.jsonl", payloads=True).call("x", {"q": 1}, lambda: {"other": 1})

    def fails():
        raise RequestError("no", "storage_unavailable")

    with pytest.raises(RequestError):
        log.call("search_doc", {}, fails)
    rows = calls.read(spark, str(tmp_path / "calls.jsonl")).collect()
    assert [(r.tool, r.ok, r.results) for r in rows] == [("search_code", True, 2), ("x", True, None), ("search_doc", False, None)]
    assert "secret" not in str(rows) and rows[1].payload and rows[2].error.startswith("storage_unavailable")
    assert calls.CallLog(tmp_path / "none" / "x").call("x", {}, lambda: {"a": 1}) == {"a": 1}
