import pytest

from tessera.plans.tables import session

CONF = {
    "spark.sql.shuffle.partitions": "2",
    "spark.driver.memory": "4g",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "500",
    # compiling costs more than it saves on a few rows
    "spark.sql.codegen.wholeStage": "false",
}


@pytest.fixture(scope="session")
def spark():
    s = session("tests", "local[4]", **CONF)
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
