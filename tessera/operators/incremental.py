"""Taking only what is new or changed.

plan() compares scanned files with stored ones by hash. The ledger functions
serve batches that arrive late, fail and repeat (problem 2): each run rereads
the deliveries of unsettled batches, of each repo from the oldest batch that
was open at the last run, and takes away by an anti-join the (file, version)
pairs that a ledger has as processed, and files settled later. The ledger and
the marks are stored together. A failed run leaves them as they were, so the
next takes the same files again; a repeated delivery is in the ledger already.

Defined results of the ledger functions: a null hash equals nothing; rows
without a batch id are older than all batches and settled; rows of a batch that
the batch table lacks have no place in the order and are left out; a delivery
whose rows spell several hashes has the least; file hashes are compared without
letter case, surrounding blanks and a leading algorithm name; null repo or path
is a key of its own; an empty table gives no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.lexical import sized

OLDEST = -1
SETTLED = "succeeded"
#: most batches that are named to the scan
FEW_BATCHES = 1_000


def plan(current: DataFrame, stored: DataFrame, failed: DataFrame | None = None) -> DataFrame:
    """(path, change) of a run: changed, unchanged, deleted or empty.

    current: path, file_hash, items (number of items parsed); stored: path,
    file_hash of the rows in scope; failed: path of files that couldn't be read
    or parsed, which keep their rows. A file without items that had some is
    deleted; unchanged are those all of whose stored rows have the hash.
    """
    old = stored.groupBy("path").agg(F.min("file_hash").alias("lo"), F.max("file_hash").alias("hi"), F.count_if(F.col("file_hash").isNull()).alias("nulls"))
    both = current.join(old, "path", "left")
    same = F.coalesce((F.col("lo") == F.col("file_hash")) & (F.col("hi") == F.col("file_hash")) & (F.col("nulls") == 0), F.lit(False))
    change = F.when(same, "unchanged").when(F.col("items") > 0, "changed").when(F.col("nulls").isNotNull(), "deleted").otherwise("empty")
    gone = old.select("path").join(current.select("path"), "path", "left_anti")
    if failed is not None:
        gone = gone.join(failed.select("path"), "path", "left_anti")
    return both.select("path", change.alias("change")).unionByName(gone.select("path", F.lit("deleted").alias("change")))


def plain_hash(h: Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_replace(h, r"^\s+|\s+$", "")), r"^[a-z0-9_\-]+:\s*", "")


def settled(status: Column) -> Column:
    return F.lower(F.regexp_replace(status, r"^\s+|\s+$", "")) == SETTLED


def deliveries(items: DataFrame, batches: DataFrame) -> DataFrame:
    """(repo, path, no, settled, version): each file's deliveries, combined before the shuffle."""
    order = batches.select("index_batch_id", F.col("batch_no").cast("long").alias("no"), F.coalesce(settled(F.col("status")), F.lit(False)).alias("settled"))
    rows = items.select("repo", "path", "index_batch_id", "file_hash").join(sized(order), "index_batch_id", "left")
    no = F.when(F.col("index_batch_id").isNull(), F.lit(OLDEST)).otherwise(F.col("no"))
    rows = rows.select("repo", "path", no.cast("long").alias("no"), F.coalesce("settled", F.col("index_batch_id").isNull()).alias("settled"), plain_hash(F.col("file_hash")).alias("version")).where("no is not null")
    return rows.groupBy("repo", "path", "no", "settled").agg(F.min("version").alias("version"))


def newest(rows: DataFrame) -> DataFrame:
    """Each file's newest delivery."""
    return rows.groupBy("repo", "path").agg(F.max_by(F.struct("no", "settled", "version"), "no").alias("d")).select("repo", "path", "d.no", "d.settled", "d.version")


def ledger(items: DataFrame, batches: DataFrame) -> DataFrame:
    """(repo, path, version, no): what successful runs have processed: each file's newest settled delivery."""
    return newest(deliveries(items, batches).where("settled")).select("repo", "path", "version", "no")


def unsettled(batches: DataFrame) -> DataFrame:
    """(index_batch_id, repo, no): the batches that aren't settled: open, failed or cancelled."""
    return batches.where(~F.coalesce(settled(F.col("status")), F.lit(False))).select("index_batch_id", "repo", F.col("batch_no").cast("long").alias("no"))


def marks(batches: DataFrame) -> DataFrame:
    """(repo, since): the oldest batch of each repo that is still running, or the one after its last; a run that ends well takes all before it."""
    running = F.lower(F.regexp_replace("status", r"^\s+|\s+$", "")) == "running"
    return batches.groupBy("repo").agg(F.coalesce(F.min(F.when(running, F.col("batch_no"))), F.max("batch_no") + 1).cast("long").alias("since"))


def pending(items: DataFrame, batches: DataFrame, done: DataFrame, since: DataFrame | None = None) -> DataFrame:
    """(repo, path, version, no): the files whose newest delivery is not settled and whose version the ledger lacks.

    Only deliveries of unsettled batches are read, of those from since (repo,
    since) on where it is given; whether a later one was settled is in the
    ledger.
    """
    open_ = unsettled(batches)
    if since is not None:
        open_ = open_.join(sized(since), "repo", "left").where("since is null or no >= since")
    names = open_.select("index_batch_id")
    few = [r[0] for r in names.limit(FEW_BATCHES + 1).collect()]
    # a stated list reaches the scan; a longer one is joined
    rows = items.where(F.col("index_batch_id").isin(*few)) if 0 < len(few) <= FEW_BATCHES else items.join(names, "index_batch_id", "left_semi")
    new = newest(deliveries(rows, batches))
    same = lambda c: F.col(f"o.{c}").eqNullSafe(F.col(f"l.{c}"))
    taken = (F.col("l.no") > F.col("o.no")) | (F.col("o.version") == F.col("l.version"))
    return new.alias("o").join(done.alias("l"), same("repo") & same("path") & F.coalesce(taken, F.lit(False)), "left_anti").select("repo", "path", "version", "no")


def advance(done: DataFrame, processed: DataFrame) -> DataFrame:
    """The ledger after a successful run over processed: the newest version of each file; running it again changes nothing."""
    rows = done.unionByName(processed)
    return rows.groupBy("repo", "path").agg(F.max_by(F.struct("version", "no"), "no").alias("d")).select("repo", "path", "d.version", "d.no")


class Ledger:
    """The stored ledger of a consumer under root, with the marks that its next run rereads from.

    A run takes pending(), does its work and commits what it took. Each commit
    writes the marks and then a whole new ledger, whose _SUCCESS, written last,
    makes it the current one: a run that fails before leaves the ledger as it
    was, and its files are pending again; committing twice changes nothing.
    """

    KEPT = 2

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _versions(self) -> list[int]:
        """The numbers of whole ledgers."""
        if not self._fs.exists(self._path("ledger")):
            return []
        found = [s.getPath().getName() for s in self._fs.listStatus(self._path("ledger"))]
        return sorted(int(x[2:]) for x in found if x.startswith("v=") and self._fs.exists(self._path(f"ledger/{x}/_SUCCESS")))

    def _read(self, name: str) -> DataFrame:
        return self.spark.read.schema("repo string, path string, version string, no long" if name == "ledger" else "repo string, since long").parquet(f"{self.root}/{name}/v={self._versions()[-1]}")

    def _write(self, rows: DataFrame, since: DataFrame) -> None:
        old = self._versions()
        n = old[-1] + 1 if old else 0
        since.select("repo", "since").write.mode("overwrite").parquet(f"{self.root}/marks/v={n}")
        rows.select("repo", "path", "version", "no").write.mode("overwrite").parquet(f"{self.root}/ledger/v={n}")
        for v in old[: 1 - self.KEPT]:
            for name in ("ledger", "marks"):
                self._fs.delete(self._path(f"{name}/v={v}"), True)

    def start(self, items: DataFrame, batches: DataFrame) -> None:
        """The ledger before the first run: what settled batches have delivered, and nothing taken of the others."""
        if not self._versions():
            self._write(ledger(items, batches), batches.groupBy("repo").agg(F.min("batch_no").cast("long").alias("since")))

    def read(self) -> DataFrame:
        return self._read("ledger")

    def since(self) -> DataFrame:
        return self._read("marks")

    def pending(self, items: DataFrame, batches: DataFrame) -> DataFrame:
        return pending(items, batches, self.read(), self.since())

    def commit(self, processed: DataFrame, batches: DataFrame) -> None:
        """processed: what pending() gave for these batches. Settled deliveries since the marks join the ledger by settle()."""
        self._write(advance(self.read(), processed), marks(batches))

    def settle(self, items: DataFrame, batches: DataFrame) -> None:
        """Take over what batches from the marks on have settled since, the marks staying."""
        new = batches.join(sized(self.since()), "repo", "left").where("since is null or batch_no >= since").where(settled(F.col("status")))
        rows = items.join(sized(new.select("index_batch_id")), "index_batch_id", "left_semi")
        self._write(advance(self.read(), newest(deliveries(rows, batches)).select("repo", "path", "version", "no")), self.since())
