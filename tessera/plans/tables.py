"""Sessions, input tables and written intermediate tables."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_CONF = "spark.checkpoint.dir"
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_written: list[tuple[SparkSession, str]] = []
_own_dirs: list[str] = []


def session(app: str = "tessera", master: str = "local[*]", **conf: str) -> SparkSession:
    """A session with the settings every plan here relies on (UTC, AQE)."""
    builder = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return importable(builder.getOrCreate())


def importable(spark: SparkSession) -> SparkSession:
    """Let Python workers find this package where it lies, as long as they see the same files."""
    root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    known = [p for p in env.get("PYTHONPATH", "").split(":") if p]
    if root not in known:
        env["PYTHONPATH"] = ":".join([root, *known])
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or one of our own where a test session has none."""
    where = spark.conf.get(_CONF, None) or spark.sparkContext.getConf().get(_CONF)
    if where:
        return where.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError(f"{_CONF} must name a folder that all executors share")
    _own_dirs.append(tempfile.mkdtemp(prefix="tessera-"))
    where = "file://" + _own_dirs[-1]
    spark.conf.set(_CONF, where)
    return where


def materialize(df: DataFrame, name: str = "t") -> DataFrame:
    """Write df to the shared folder and read it back.

    Cuts the lineage with a table that outlives lost executors, computed once
    (Dataset.checkpoint() runs its plan twice). The files go when the
    interpreter ends, or with release().
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._tessera_path = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def release(*tables: DataFrame) -> None:
    """Delete materialized tables that no later plan reads."""
    for df in tables:
        path = getattr(df, "_tessera_path", None)
        for entry in [x for x in _written if x[1] == path]:
            _delete(*entry)
            _written.remove(entry)


@contextmanager
def scratch() -> Iterator[list[DataFrame]]:
    """Delete at its end the tables materialized within, but those put in the list."""
    mark, keep = len(_written), []
    try:
        yield keep
    finally:
        kept = {getattr(df, "_tessera_path", None) for df in keep}
        for entry in _written[mark:]:
            if entry[1] not in kept:
                _delete(*entry)
                _written.remove(entry)


@contextmanager
def option(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """Within the block, the session's option has this value."""
    was = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.unset(name) if was is None else spark.conf.set(name, was)


def shuffles_deleted(spark: SparkSession):
    """Within the block, the shuffle files of each query are deleted when it ends, not when the driver happens to collect its garbage."""
    return option(spark, _CLEANUP, "true")


@contextmanager
def workspace(spark: SparkSession, name: str) -> Iterator[str]:
    """A folder beside the written tables, deleted at the end of the block (or of the interpreter)."""
    entry = (spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")
    _written.append(entry)
    try:
        yield entry[1]
    finally:
        _delete(*entry)
        _written.remove(entry)


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        try:
            if path.startswith("file:"):
                shutil.rmtree(path.removeprefix("file://").removeprefix("file:"), ignore_errors=True)
            else:
                _delete(spark, path)
        except Exception:  # the session may be gone already
            continue
    for path in _own_dirs:
        shutil.rmtree(path, ignore_errors=True)
