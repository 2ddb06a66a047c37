import os

import pytest

from tessera.llm import queries
from tests.oracle import rows_of, sql_rows

SMALL = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, name):
    cols, got = rows_of(queries.QUERIES[name](spark, SMALL))
    if name in queries.ORACLE:
        names, want = sql_rows(queries.ORACLE[name], SMALL)
        assert cols == names and got == want
