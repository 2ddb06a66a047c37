"""A store of items, symbols and embeddings as snapshots behind a pointer.

A run writes new directories and then replaces the pointer by a rename: readers
see the old snapshot or the new one, and a run that fails leaves the old one.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.sources.schema import KEYS, SCHEMAS


def last_wins(rows: DataFrame, keys: tuple[str, ...], order: str) -> DataFrame:
    """One row for each key, the last by order."""
    w = Window.partitionBy(*keys).orderBy(F.desc(order))
    return rows.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def upsert(existing: DataFrame, new: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """existing with the rows of new in place of those of equal keys; new has each key once."""
    return existing.join(new.select(*keys), list(keys), "left_anti").unionByName(new)


def without_paths(df: DataFrame, repo: str, paths: DataFrame) -> DataFrame:
    """df without the repo's rows of the given paths; other repos stay."""
    return df.join(paths.select("path").distinct().withColumn("repo", F.lit(repo)), ["repo", "path"], "left_anti")


def without_prefix(df: DataFrame, repo: str, prefix: str) -> DataFrame:
    return df.where(~F.coalesce((F.col("repo") == repo) & F.col("path").startswith(prefix), F.lit(False)))


def cascade(embeddings: DataFrame, items: DataFrame) -> DataFrame:
    """The embeddings whose item is still there."""
    return embeddings.join(items.select("repo", F.col("id").alias("item_id")), ["repo", "item_id"], "left_semi")


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = lambda name: jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        self._fs = self._path("x").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._jvm = jvm

    def _pointer(self) -> dict[str, str]:
        if not self._fs.exists(self._path("_CURRENT")):
            return {}
        stream = self._fs.open(self._path("_CURRENT"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def read(self, table: str) -> DataFrame:
        """The table as it is now; the pointer is resolved once."""
        at = self._pointer().get(table)
        return self.spark.read.schema(SCHEMAS[table]).parquet(f"{self.root}/{at}") if at else self.spark.createDataFrame([], SCHEMAS[table])

    def commit(self, **tables: DataFrame) -> None:
        """Write the given tables and make them current together."""
        pointer = self._pointer()
        for name, df in tables.items():
            at = f"{name}-{uuid.uuid4().hex}"
            rows = df.select(*[x.split()[0] for x in SCHEMAS[name].split(", ")])
            if name == "embeddings":
                rows = checked(rows)
            rows.write.parquet(f"{self.root}/{at}")
            pointer[name] = at
        new = self._path(f"_CURRENT.{uuid.uuid4().hex}")
        stream = self._fs.create(new, True)
        stream.write(bytearray(json.dumps(pointer).encode()))
        stream.close()
        options = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        rename = self._jvm.org.apache.hadoop.fs.Options.Rename
        array = self.spark.sparkContext._gateway.new_array(rename, 1)
        array[0] = rename.OVERWRITE
        options.rename(new, self._path("_CURRENT"), array)

    def vacuum(self) -> int:
        """Delete what no pointer names; not while another run writes or reads an older snapshot."""
        keep, gone = set(self._pointer().values()), 0
        for status in self._fs.listStatus(self._path(".")):
            name = status.getPath().getName()
            if status.isDirectory() and name not in keep and name.split("-")[0] in SCHEMAS:
                gone += bool(self._fs.delete(status.getPath(), True))
        return gone

    def save(self, table: str, rows: DataFrame, order: str | None = None) -> None:
        """Upsert rows by the table's keys, the last of equal ones by order."""
        new = last_wins(rows, KEYS[table], order) if order else rows.dropDuplicates(list(KEYS[table]))
        old = self.read(table)
        self.commit(**{table: upsert(old, new.select(*old.columns), KEYS[table])})


def checked(embeddings: DataFrame) -> DataFrame:
    """embeddings; the write fails at a vector that hasn't its dimension."""
    wrong = (F.col("dimension") <= 0) | (F.size("embedding") != F.col("dimension"))
    text = F.concat(F.lit("vector of "), F.size("embedding").cast("string"), F.lit(" where dimension is "), F.col("dimension").cast("string"))
    return embeddings.withColumn("dimension", F.when(F.coalesce(wrong, F.lit(True)), F.raise_error(F.coalesce(text, F.lit("no vector"))).cast("int")).otherwise(F.col("dimension")))
