"""Every registered query of the core against its SQL, on the smallest tables."""

import ast
import os
import re

import pytest

from tessera.plans import oracle, queries
from tests.oracle import rows_of, sql_rows

SMALL = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables here")


@needs_data
@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, name):
    cols, got = rows_of(queries.QUERIES[name](spark, SMALL))
    if name in oracle.ORACLE:
        names, want = sql_rows(oracle.ORACLE[name], SMALL)
        assert cols == names and got == want


def test_entry_lists_what_the_sql_lists():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


def test_the_core_imports_nothing_of_llm():
    root = os.path.dirname(os.path.dirname(os.path.abspath(queries.__file__)))
    for folder, _, files in os.walk(root):
        if os.path.basename(folder) == "llm":
            continue
        for f in files:
            if f.endswith(".py"):
                for node in ast.walk(ast.parse(open(os.path.join(folder, f)).read())):
                    named = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
                    assert not any(re.match(r"tessera\.llm\b", n) for n in named), f
