"""Problem 7: new batches against all history, by a segment index.

The segment index for edit distance stores a fixed number of segments of each
string by its length and the segment's position, probes the segments of a new
string, verifies a bounded edit distance and appends the new string's segments.
Here the string of a content is its shingle set in hash order: the insertions
and deletions between two such strings are the symmetric difference of the
sets, and a similarity of t allows (1 - t) / (1 + t) * (|x| + |y|) of them, of
which a set of n tokens sees D = floor((1 - t) / t * n) at most. The strings
are cut by hash range into 2**level segments, the level given by the length. At
most D of any D + 1 filled segments differ, so that D + 1 are stored, under
(level, position, hash), and a partner of any allowed length probes its own
segments at the level of each length that it may meet. Frequent tokens (a list
fixed with the first load; it decides speed alone) are left out of the
segments; sets that fill too few store each token, met by the prefix of the
prober's tokens. Candidates come from signature trees over stored and probed
segments, as in problem 3. All of it is exact: nothing is capped, and the
distance is verified on the whole sets.

SegmentIndex keeps its tables over loads. A content is cut, stored and probed
once, when a load first brings it; later loads and checks read its links.

Defined results: a null hash equals nothing; rows without a batch id are older
than all batches; rows of a batch that the batch table lacks have no order and
are neither checked nor held against others; contents of under least_words
words are only checked by hash; null identity columns equal each other; an
empty table gives no row.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm import shingles as S
from tessera.operators.incremental import plain_hash
from tessera.plans.tables import materialize, option, scratch, shuffles_deleted, workspace

SIG = [f"s{i}" for i in range(S.SIG_WORDS)]
SIGNS = "n int, c int, " + ", ".join(f"{s} long" for s in SIG)
#: the tables of an index: columns, and the one whose hash makes the buckets
TABLES = {
    "sets": (f"cid long, md5 binary, {SIGNS}, toks array<long>, wide array<long>", "cid"),
    "segments": ("key long, cid long", "key"),
    "links": ("a long, b long, distance long", "a"),
    "members": ("md5 binary, who binary, at long", "md5"),
    "hashes": ("h string, at long", "h"),
}


def _level(n: np.ndarray) -> np.ndarray:
    return np.ceil(np.log2(np.maximum(1, n))).astype(np.int64)


def _single(toks: np.ndarray) -> np.ndarray:
    return S._mix(toks.view(np.uint64) ^ np.uint64(0x5851F42D4C957F2D)).view(np.int64)


def _places(owner: np.ndarray) -> np.ndarray:
    """Each element's place among those of its owner (owners in order)."""
    start = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]]) if len(owner) else np.empty(0, np.int64)
    return np.arange(len(owner)) - np.repeat(start, np.diff(np.r_[start, len(owner)]))


class Cut:
    """Many sets at once: their tokens one after the other, rising in each, rank above 0 for frequent tokens, n the sets' sizes."""

    def __init__(self, toks: np.ndarray, n: np.ndarray, rank: np.ndarray, t: float):
        self.t, self.n = t, n
        owner = np.repeat(np.arange(len(n)), n)
        # in the order of unsigned numbers, the tokens below 0 come last in their set
        below = np.bincount(owner[toks < 0], minlength=len(n))
        start = np.cumsum(n) - n
        by = np.arange(len(toks)) + np.repeat(below, n)
        by -= np.where(by >= np.repeat(start + n, n), np.repeat(n, n), 0)
        self.toks, self.rank, self.owner = toks[by], rank[by], owner
        rare = self.rank == 0
        self.u, self.of = self.toks[rare].view(np.uint64), self.owner[rare]
        self.mixed = S._mix(self.u)

    def _segments(self, level: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The filled segments' keys, numbers of tokens and owners; a set of level below 0 has none."""
        on = level[self.of] >= 0
        u, of, mixed = self.u[on], self.of[on], self.mixed[on]
        if not len(u):
            return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
        depth = level[of].astype(np.uint64)
        pos = np.where(depth > 0, u >> (np.uint64(64) - np.maximum(depth, np.uint64(1))), np.uint64(0))
        at = np.flatnonzero(np.r_[True, (pos[1:] != pos[:-1]) | (of[1:] != of[:-1])])
        h = np.add.reduceat(mixed, at)
        keys = S._mix(h ^ S._mix(pos[at] * np.uint64(64) + depth[at]))
        return keys.view(np.int64), np.diff(np.r_[at, len(u)]), of[at]

    def stored(self) -> tuple[np.ndarray, np.ndarray]:
        """Keys and owners: D + 1 segments of each set, those of most tokens, else each token."""
        keys, size, owner = self._segments(_level(self.n))
        most = np.floor((1 - self.t) / self.t * self.n + 1e-9).astype(np.int64)
        enough = np.bincount(owner, minlength=len(self.n)) > most
        by = np.lexsort((-size, owner))
        keys, owner = keys[by], owner[by]
        ok = enough[owner] & (_places(owner) <= most[owner])
        few = ~enough[self.owner]
        return np.concatenate([keys[ok], _single(self.toks[few])]), np.concatenate([owner[ok], self.owner[few]])

    def probed(self) -> tuple[np.ndarray, np.ndarray]:
        """Keys and owners that meet every stored set of similarity t: the segments at each level of an allowed length, and the prefix of the tokens, the rarest first."""
        least = np.ceil(self.t * self.n - 1e-9).astype(np.int64)
        lo, hi = _level(least), _level(np.floor(self.n / self.t + 1e-9).astype(np.int64))
        keys, owners = [], []
        for step in range(int((hi - lo).max()) + 1 if len(lo) else 0):
            k, _, owner = self._segments(np.where(lo + step <= hi, lo + step, -1))
            keys.append(k)
            owners.append(owner)
        by = np.lexsort((self.rank, self.owner))
        owner = self.owner[by]
        ok = _places(owner) < (self.n - least + 1)[owner]
        return np.concatenate([*keys, _single(self.toks[by[ok]])]), np.concatenate([*owners, owner[ok]])


def _sets(texts: DataFrame, k: int, least_words: int) -> DataFrame:
    """The table of sets: the shingle set of each content (cid, md5, content) of least_words words, with its signature."""

    def run(batches):
        for batch in batches:
            cids, keys, texts = [], [], []
            for cid, key, text in zip(*(c.to_pylist() for c in batch.columns)):
                w = S.words(text)
                if len(w) >= max(least_words, k):
                    cids.append(cid)
                    keys.append(key)
                    texts.append(w)
            flat, n = S.all_shingle_hashes(texts, k)
            sig, c = S.signatures(flat, n)
            words, shared = S.signatures(flat, n, S.WIDE_WORDS)
            wide = np.column_stack([words.view(np.int64), shared])
            cols = [pa.array(cids, pa.int64()), pa.array(keys, pa.binary()), pa.array(n.astype(np.int32)), pa.array(c.astype(np.int32)), *[pa.array(np.ascontiguousarray(x)) for x in sig.view(np.int64).T]]
            yield pa.RecordBatch.from_arrays([*cols, S.flat_lists(flat, n), S.flat_lists(wide.ravel(), np.full(len(n), S.WIDE_WORDS + 1))], names=["cid", "md5", "n", "c", *SIG, "toks", "wide"])

    return texts.select("cid", "md5", "content").mapInArrow(run, TABLES["sets"][0])


def _cut(column: pa.ListArray, freq: S.Frequencies, t: float) -> Cut:
    toks = column.flatten().to_numpy(zero_copy_only=False)
    return Cut(toks, np.diff(column.offsets.to_numpy()), freq.ranks(toks), t)


def delivered(df: DataFrame, row_id: str, content: str, file_hash: str, identity: list[str], at: Column) -> DataFrame:
    """(row, who, at, h, md5, content): rows as an index takes them; at is their place in the order of batches, those without one are left out."""
    who = F.to_json(F.struct(*[F.col(c).cast("string").alias(str(i)) for i, c in enumerate(identity)]))
    return df.select(F.col(row_id).cast("long").alias("row"), S.text_key(who).alias("who"), at.cast("long").alias("at"), plain_hash(F.col(file_hash)).alias("h"), S.text_key(F.col(content)).alias("md5"), F.col(content).alias("content")).where("at is not null")


def _first_two(rows: DataFrame, of: str = "cid") -> DataFrame:
    """Of (of, who, at): for each of its two earliest (at, who) of different who; limited before the shuffle."""
    least = rows.groupBy(of, "who").agg(F.min("at").alias("at"))
    w = Window.partitionBy(of).orderBy("at", "who")
    return least.withColumn("k", F.row_number().over(w)).where("k <= 2").drop("k")


class SegmentIndex:
    """A kept index under root, of bucketed tables with a partition for each load.

    accept() adds a load and commits it by a mark in root/loads, written last.
    Loads without a mark are not read; accepting a load again replaces what a
    failed run left of it, and does nothing once it is committed. check() holds
    rows against the committed loads, earlier places (at) only.
    """

    def __init__(self, spark: SparkSession, root: str, t: float = 0.8, k: int = 5, least_words: int = 5, buckets: int | None = None):
        self.spark, self.root, self.t, self.k, self.least_words = spark, root.rstrip("/"), t, k, least_words
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
        self._fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._name = f"tessera_index_{uuid.uuid4().hex}"
        if self._exists("settings/_SUCCESS"):
            kept = spark.read.parquet(f"{self.root}/settings").first()
            if (kept.t, kept.k, kept.least_words) != (t, k, least_words):
                raise ValueError(f"the index at {root} was made for t, k, least_words = {kept.t}, {kept.k}, {kept.least_words}")
            self.buckets = kept.buckets
        else:
            self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
            spark.createDataFrame([(t, k, least_words, self.buckets)], "t double, k int, least_words int, buckets int").coalesce(1).write.mode("overwrite").parquet(f"{self.root}/settings")
        for table, (schema, key) in TABLES.items():
            spark.sql(f"CREATE TABLE {self._name}_{table} ({schema}, load STRING) USING parquet PARTITIONED BY (load) CLUSTERED BY ({key}) INTO {self.buckets} BUCKETS LOCATION '{self.root}/{table}'")
            for load in self.loads():
                spark.sql(f"ALTER TABLE {self._name}_{table} ADD IF NOT EXISTS PARTITION (load = '{load}')")

    def close(self) -> None:
        """Forget the tables' names; the files stay."""
        for table in TABLES:
            self.spark.sql(f"DROP TABLE IF EXISTS {self._name}_{table}")

    def _path(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _exists(self, name: str) -> bool:
        return self._fs.exists(self._path(name))

    def loads(self) -> list[str]:
        """The committed loads."""
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path("loads"))) if self._exists("loads") else []

    def _read(self, table: str, *more: str) -> DataFrame:
        return self.spark.table(f"{self._name}_{table}").where(F.col("load").isin(*self.loads(), *more)).drop("load")

    def _write(self, table: str, load: str, df: DataFrame) -> None:
        schema, key = TABLES[table]
        columns = [c.split()[0] for c in schema.split(", ")]
        view = f"{self._name}_new"
        df.select(*columns).repartition(self.buckets, key).createOrReplaceTempView(view)
        # what a failed run left; the load isn't committed, so that nothing reads it
        self._fs.delete(self._path(f"{table}/load={load}"), True)
        # a task's rows are of one bucket; they need no sorting by it
        with option(self.spark, "spark.sql.maxConcurrentOutputFileWriters", "2"):
            self.spark.sql(f"INSERT INTO {self._name}_{table} PARTITION (load = '{load}') SELECT * FROM {view}")
        self.spark.catalog.dropTempView(view)

    def _frequent(self, sets: DataFrame) -> S.Frequencies:
        """The frequent tokens: of the first load, kept with the index."""
        if not self._exists("frequent/_SUCCESS"):
            hot, rank = S.frequent(sets)
            self.spark.createDataFrame([(hot.tolist(), rank.tolist())], "hot array<long>, place array<long>").coalesce(1).write.mode("overwrite").parquet(f"{self.root}/frequent")
        kept = self.spark.read.parquet(f"{self.root}/frequent").first()
        return S.Frequencies(np.zeros(1, np.uint64), np.array(kept.hot, np.int64), np.array(kept.place, np.int64))

    def _links(self, new: DataFrame, load: str | None = None) -> DataFrame:
        """(a, b, distance, sim): the new sets against those of the committed loads, and of load."""
        t, more = self.t, [load] if load else []
        stored = self._read("segments", *more)
        total = sum(self.spark.table(f"{self._name}_segments").where(F.col("load") == x).count() for x in [*self.loads(), *more])
        # a probe that no stored set has, or none but the prober itself, meets nothing; full bitmaps cost only speed
        with option(self.spark, "spark.sql.sources.bucketing.autoBucketedScan.enabled", "false"):
            bits = S.BucketBits.of(stored, total, self.buckets)
        shared = self.spark.sparkContext.broadcast((self._frequent(new), bits, load is not None))

        def run(batches):
            freq, bits, inside = shared.value
            for batch in batches:
                cut = _cut(batch.column(len(signs)), freq, t)
                keys, owner = cut.probed()
                ok, several = bits.held(keys)
                keys, owner, several = keys[ok], owner[ok], several[ok]
                if inside:
                    own, by = cut.stored()
                    mark = lambda k, o: S._mix(k.view(np.uint64) + S._mix(o.astype(np.uint64) + np.uint64(1)))
                    ok = several | ~np.isin(mark(keys, owner), mark(own, by))
                    keys, owner = keys[ok], owner[ok]
                at = pa.array(owner)
                for lo in range(0, len(keys), 1 << 16):
                    part = slice(lo, lo + (1 << 16))
                    yield pa.RecordBatch.from_arrays([pa.array(keys[part]), *[batch.column(i).take(at[part]) for i in range(len(signs))]], names=["key", *signs])

        signs = ["cid", "n", "c", *SIG]
        probes = materialize(new.select(*signs, "toks").mapInArrow(run, f"key long, cid long, {SIGNS}"), "probes")
        shared.destroy()
        sets = self._read("sets", *more)
        # the probes' keys are few, and kept once when hashed; that spares sorting all that is stored
        met = stored.join(probes.select("key").hint("shuffle_hash"), "key", "left_semi")
        entries = met.join(sets.select(*signs), "cid").withColumn("role", F.lit(1 | 64)).unionByName(probes.withColumn("role", F.lit(2 | 32)))
        whole = sets.select("cid", "n", "toks", "wide")
        return S.verified(S.block_pairs(entries.select("key", "cid", "n", "c", "role", *SIG), t, stored.select("key").unionByName(probes.select("key")), 2 * total), whole if load else whole.unionByName(new.select("cid", "n", "toks", "wide")), t)

    def keys(self, rows: DataFrame) -> DataFrame:
        """The rows (see delivered) without their contents, and whether these are long enough for a set; written once for accept() and check()."""
        return materialize(rows.select("row", "who", "at", "h", "md5", (F.length("content") >= self.least_words).alias("long")), "keys")

    def accept(self, load: str, rows: DataFrame, keys: DataFrame | None = None) -> None:
        """Add rows (see delivered) as a load of this name, unless it is committed already."""
        if load in self.loads():
            return
        with scratch():
            keys = self.keys(rows) if keys is None else keys
            texts = S.content_classes(rows, "row", "content", self.least_words)
            if self.loads():
                texts = texts.join(self._read("members").select("md5"), "md5", "left_anti")
            self._write("sets", load, _sets(texts, self.k, self.least_words))
            new = self.spark.table(f"{self._name}_sets").where(F.col("load") == load).drop("load")
            shared, t = self.spark.sparkContext.broadcast(self._frequent(new)), self.t

            def run(batches):
                for batch in batches:
                    keys, owner = _cut(batch.column(1), shared.value, t).stored()
                    yield pa.RecordBatch.from_arrays([pa.array(keys), batch.column(0).take(pa.array(owner))], names=["key", "cid"])

            self._write("segments", load, new.select("cid", "toks").mapInArrow(run, "key long, cid long"))
            shared.destroy()
            self._write("links", load, self._links(new, load))
            self._write("members", load, keys.where("long").groupBy("md5", "who").agg(F.min("at").alias("at")))
            self._write("hashes", load, keys.where("h is not null").groupBy("h").agg(F.min("at").alias("at")))
        self._fs.create(self._path(f"loads/{load}"), True).close()

    def check(self, rows: DataFrame, keys: DataFrame | None = None) -> DataFrame:
        """(row, kind): the rows (see delivered) of which an earlier row has an equal hash (same), or another identity and a similar content (near)."""
        first = self._read("hashes").groupBy("h").agg(F.min("at").alias("first"))
        keys = self.keys(rows) if keys is None else keys
        seen = keys.join(first, "h", "left").select("row", "who", "md5", "at", F.coalesce(F.col("first") < F.col("at"), F.lit(False)).alias("same"))
        seen = materialize(seen, "rows")
        known = self._read("sets").select("md5", "cid")
        links = self._read("links").select("a", "b")
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # a member without a set is known to be too short
        unknown = materialize(keys.where("long").select("md5").distinct().join(self._read("members").select("md5"), "md5", "left_anti"), "unknown")
        if unknown.limit(1).count():
            new = S.content_classes(rows.join(unknown, "md5", "left_semi"), "row", "content", self.least_words)
            new = materialize(_sets(new.withColumn("cid", -F.col("cid") - 1), self.k, self.least_words), "new")
            known = known.unionByName(new.select("md5", "cid"))
            # ids of unknown contents are below 0
            both = both.unionByName(self._links(new).select("a", "b"))
        member = materialize(seen.where("not same").join(known, "md5").select("cid", "row", "who", "at"), "member")
        two = _first_two(self._read("members"), "md5").join(self._read("sets").select("md5", "cid"), "md5").select("cid", "who", "at")
        two = materialize(two, "two")
        beside = both.withColumnsRenamed({"a": "cid", "b": "to"}).join(two.withColumnRenamed("cid", "to"), "to").select("cid", "who", "at")
        early = _first_two(two.unionByName(beside)).groupBy("cid").agg(F.min(F.struct("at", "who")).alias("e1"), F.max(F.struct("at", "who")).alias("e2"))
        e = F.when(F.col("e1.who") != F.col("who"), F.col("e1.at")).when(F.col("e2.who") != F.col("who"), F.col("e2.at"))
        near = member.join(early, "cid").where(e < F.col("at")).select("row", F.lit("near").alias("kind"))
        return seen.where("same").select("row", F.lit("same").alias("kind")).unionByName(near)


def repeated_rows(items: DataFrame, batches: DataFrame, t: float = 0.8, k: int = 5, least_words: int = 5, loads: int = 2) -> DataFrame:
    """(row_seq, kind): rows of each batch that repeat (same) or nearly repeat (near) rows of earlier batches.

    The batches go in their order into an index, some consecutive ones to a
    load; each load is accepted and then checked, each row against what is
    earlier than its own batch.
    """
    order = materialize(batches.select("index_batch_id", F.col("batch_no").cast("long").alias("no")), "order")
    lo, hi = order.agg(F.min("no"), F.max("no")).first()
    at = F.when(F.col("index_batch_id").isNull(), F.lit(-1)).otherwise(F.col("no"))
    rows = items.select("row_seq", "repo", "id", "index_batch_id", "file_hash", "content").join(F.broadcast(order) if order.limit(20_001).count() <= 20_000 else order, "index_batch_id", "left")
    rows = delivered(rows, "row_seq", "content", "file_hash", ["repo", "id"], at)
    cuts = [] if lo is None else [lo + (hi + 1 - lo) * i // loads for i in range(1, loads)]
    out = None
    with scratch() as keep, workspace(items.sparkSession, "index") as root, shuffles_deleted(items.sparkSession):
        index = SegmentIndex(items.sparkSession, root, t, k, least_words)
        keys = index.keys(rows)
        for i, (begin, end) in enumerate(zip([None, *cuts], [*cuts, None])):
            # every load but the first comes after batch number begin
            within = (F.lit(True) if begin is None else F.col("at") >= begin) & (F.lit(True) if end is None else F.col("at") < end)
            part, own = rows.where(within), keys.where(within)
            index.accept(f"part-{i}", part, own)
            got = index.check(part, own).select(F.col("row").alias("row_seq"), "kind")
            keep.append(got := materialize(got, "repeated"))
            out = got if out is None else out.unionByName(got)
        index.close()
    return out
