"""Word shingles of contents, and the filtered similarity join over them.

Shared by the near-duplicate operators. A content becomes the set of 64-bit
hashes of its runs of consecutive words; copies of one content are one class,
named by its least row id.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.plans.tables import materialize, release

WORD = re.compile(r"[a-z0-9_]+|[一-鿿]")
#: least and most bits (as powers of 2) of a bitmap of tokens or keys, and most entries of the list of frequent tokens
BITMAP, MOST_FREQUENT = (20, 28), 1 << 16
#: tokens or keys that a task counts at once
COUNTED = 1 << 21
#: words of a set's token bitmap in the trees, and of the one that candidates are held against before their sets are
SIG_WORDS, WIDE_WORDS = 4, 16
#: entries of a block that is cut into cells, of a cell, and of a task's tree (a block more); cells or nodes of a node above
HOT_BLOCK, CELL, CHUNK, CELL_FAN = 4096, 2048, 1 << 17, 16
ENTRY = "key long, cid long, n int, c int, role int, " + ", ".join(f"s{i} long" for i in range(SIG_WORDS))


def words(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


class _WordHashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > 1_000_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_HASHES = _WordHashes()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(tokens: list[str], k: int) -> np.ndarray:
    """The sorted distinct hashes of the runs of k words."""
    w = np.fromiter(map(_HASHES.__getitem__, tokens), np.uint64, len(tokens))
    m = len(w) - k + 1
    if m <= 0:
        return np.empty(0, np.int64)
    h = np.zeros(m, np.uint64)
    for i in range(k):
        h = _mix(h * np.uint64(0x9E3779B97F4A7C15) + w[i : i + m])
    return np.unique(h.view(np.int64))


def all_shingle_hashes(texts: list[list[str]], k: int) -> tuple[np.ndarray, np.ndarray]:
    """shingle_hashes of many texts of at least k words each, hashed at once: one after the other, and their numbers."""
    if not texts:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    size = np.array([len(w) for w in texts])
    w = np.fromiter(map(_HASHES.__getitem__, chain.from_iterable(texts)), np.uint64, size.sum())
    m = len(w) - k + 1
    h = np.zeros(m, np.uint64)
    for i in range(k):
        h = _mix(h * np.uint64(0x9E3779B97F4A7C15) + w[i : i + m])
    # runs over the end of a text are left out
    h, end, runs = h.view(np.int64), np.cumsum(size), size - k + 1
    new = np.zeros(m, bool)
    for b, e in zip((end - size).tolist(), (end - k + 1).tolist()):
        h[b:e].sort()
        new[b] = True
    inside = np.repeat(end - size - np.cumsum(runs) + runs, runs) + np.arange(runs.sum())
    first = (new | np.r_[True, h[1:] != h[:-1]])[inside]
    return h[inside[first]], np.bincount(np.repeat(np.arange(len(size)), runs)[first], minlength=len(size))


def lists(values: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    offsets = np.zeros(len(values) + 1, np.int32)
    np.cumsum([len(v) for v in values], out=offsets[1:])
    flat = np.concatenate(values) if values else np.empty(0, kind.to_pandas_dtype())
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, kind))


def flat_lists(values: np.ndarray, n: np.ndarray) -> pa.ListArray:
    """Lists of n values each, one after the other."""
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n)].astype(np.int32)), pa.array(values))


def text_key(text: Column) -> Column:
    """The MD5 of a text, as 16 bytes."""
    return F.unhex(F.md5(text.cast("binary")))


def content_classes(df: DataFrame, row_id: str, content: str, least_chars: int) -> DataFrame:
    """(md5, cid, content): one row for each distinct content of at least least_chars characters, combined before the shuffle."""
    text = F.col(content)
    return (
        df.where(text.isNotNull() & (F.length(text) >= least_chars))
        .select(F.col(row_id).alias("r"), text.alias("content"), text_key(text).alias("md5"))
        .groupBy("md5")
        .agg(F.min("r").alias("cid"), F.first("content").alias("content"))
    )


def shingle_sets(classes: DataFrame, k: int, least_words: int) -> DataFrame:
    """(cid, md5, toks): the shingle set of each class of at least least_words words."""

    def run(batches):
        for batch in batches:
            cids, keys, sets = [], [], []
            for cid, key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                w = words(text)
                if len(w) >= max(least_words, k):
                    cids.append(cid)
                    keys.append(key)
                    sets.append(shingle_hashes(w, k))
            yield pa.RecordBatch.from_arrays([pa.array(cids, pa.int64()), pa.array(keys, pa.binary()), lists(sets, pa.int64())], names=["cid", "md5", "toks"])

    return classes.select("cid", "md5", "content").mapInArrow(run, "cid long, md5 binary, toks array<long>")


@dataclass
class Frequencies:
    """What fits in a fixed space of the shingles' record counts.

    seen: a bitmap of at most 2**28 bits (32 MB), one of a token's bits clear only if one
    record at most holds it; hot, rank: the at most MOST_FREQUENT tokens of more than
    total / MOST_FREQUENT records, with their place by rising count. Both have a
    bound that doesn't grow with the data. A full bitmap only costs speed.
    """

    seen: np.ndarray
    hot: np.ndarray
    rank: np.ndarray

    def repeated(self, toks: np.ndarray) -> np.ndarray:
        return in_bitmap(self.seen, toks)

    def ranks(self, toks: np.ndarray) -> np.ndarray:
        """0 for a token that isn't hot, else its place among the hot ones from 1."""
        if not len(self.hot):
            return np.zeros(len(toks), np.int64)
        at = np.minimum(np.searchsorted(self.hot, toks), len(self.hot) - 1)
        return np.where(self.hot[at] == toks, self.rank[at], 0)


def key_bitmaps(counts: DataFrame, total: int, column: str = "key") -> tuple[np.ndarray, np.ndarray]:
    """Bitmaps of two hashes of all keys, and of those of a count f above 1: 16 bits or more for each of total keys, as far as BITMAP allows."""
    power = min(BITMAP[1], max(BITMAP[0], int(total).bit_length() + 4))
    bits = [F.shiftrightunsigned(F.col(column), x).bitwiseAND(F.lit((1 << power) - 1)) for x in (0, 64 - power)]
    rows = counts.select("f", F.explode(F.array(*bits)).alias("at"))
    bit = F.expr("shiftleft(1L, cast(at & 63 as int))")
    got = rows.groupBy(F.shiftright("at", 6).alias("w")).agg(F.bit_or(bit).alias("b"), F.coalesce(F.bit_or(F.when(F.col("f") > 1, bit)), F.lit(0)).cast("long").alias("c")).toArrow()
    out = []
    for x in "bc":
        out.append(np.zeros(1 << (power - 6), np.uint64))
        out[-1][got["w"].to_numpy()] = got[x].to_numpy().view(np.uint64)
    return out[0], out[1]


def in_bitmap(seen: np.ndarray, keys: np.ndarray) -> np.ndarray:
    u, ok = keys.view(np.uint64), np.ones(len(keys), bool)
    power = 6 + (len(seen) - 1).bit_length()
    for x in (0, 64 - power):
        at = (u >> np.uint64(x)) & np.uint64((1 << power) - 1)
        ok &= (seen[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1
    return ok


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """The buckets that Spark puts longs into: their Murmur3 hash of seed 42, modulo buckets."""
    u = keys.view(np.uint64)
    h = np.full(len(u), 42, np.uint32)
    for half in (u.astype(np.uint32), (u >> np.uint64(32)).astype(np.uint32)):
        k = half * np.uint32(0xCC9E2D51)
        h ^= ((k << np.uint32(15)) | (k >> np.uint32(17))) * np.uint32(0x1B873593)
        h = ((h << np.uint32(13)) | (h >> np.uint32(19))) * np.uint32(5) + np.uint32(0xE6546B64)
    h ^= np.uint32(8)
    h = (h ^ (h >> np.uint32(16))) * np.uint32(0x85EBCA6B)
    h = (h ^ (h >> np.uint32(13))) * np.uint32(0xC2B2AE35)
    return np.mod((h ^ (h >> np.uint32(16))).view(np.int32), np.int32(buckets)).astype(np.int64)


@dataclass
class BucketBits:
    """Bitmaps of the keys of a bucketed table, each bucket's in a slice of 2**power bits: of all keys, and of those that several rows have."""

    buckets: int
    power: int
    any_: np.ndarray
    several: np.ndarray

    @staticmethod
    def places(keys: np.ndarray, buckets: int, power: int) -> list[np.ndarray]:
        """A key's two bits."""
        u, base = keys.view(np.uint64), bucket_of(keys, buckets) << power
        return [base + ((u >> np.uint64(x)) & np.uint64((1 << power) - 1)).astype(np.int64) for x in (0, 64 - power)]

    @classmethod
    def of(cls, rows: DataFrame, total: int, buckets: int) -> BucketBits:
        """Of the rows' key, 16 bits or more for each of total rows, as far as BITMAP allows.

        A task that reads whole buckets writes their slices only, and nothing is
        shuffled. What two tasks or chunks both hold counts as several rows.
        """
        power = min(24, max(6, min(BITMAP[1], max(BITMAP[0], int(total).bit_length() + 4)) - (buckets - 1).bit_length()))
        low = (1 << power) - 1

        def add(found: dict, held: list[np.ndarray]) -> None:
            keys, f = np.unique(np.concatenate(held), return_counts=True)
            x, y = cls.places(keys, buckets, power)
            which = x >> power
            for b in np.flatnonzero(np.bincount(which, minlength=buckets)).tolist():
                any_, several = found.setdefault(b, np.zeros((2, low + 1), bool))
                own = which == b
                p, q = x[own] & low, y[own] & low
                more = (f[own] > 1) | any_[p] & any_[q]
                any_[p] = any_[q] = True
                several[p[more]] = several[q[more]] = True

        def run(batches):
            found, held, size = {}, [], 0
            for batch in batches:
                held.append(batch.column(0).to_numpy())
                size += batch.num_rows
                if size >= COUNTED:
                    add(found, held)
                    held, size = [], 0
            if size:
                add(found, held)
            for b, bits in found.items():
                cols = [b, *(np.packbits(x, bitorder="little").tobytes() for x in bits)]
                yield pa.RecordBatch.from_arrays([pa.array([x], kind) for x, kind in zip(cols, (pa.int32(), pa.binary(), pa.binary()))], names=["bucket", "any_", "several"])

        out = cls(buckets, power, *np.zeros((2, buckets << (power - 3)), np.uint8))
        got = rows.select("key").mapInArrow(run, "bucket int, any_ binary, several binary").toArrow()
        for b, any_, several in zip(*(got.column(i).to_pylist() for i in range(3))):
            at = slice(b << (power - 3), (b + 1) << (power - 3))
            any_ = np.frombuffer(any_, np.uint8)
            out.several[at] |= np.frombuffer(several, np.uint8) | out.any_[at] & any_
            out.any_[at] |= any_
        return out

    def held(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether the table may have each key, and in several rows."""
        places = self.places(keys, self.buckets, self.power)
        return tuple(np.logical_and(*((bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 for at in places)) for bits in (self.any_, self.several))


def _counted(sets: DataFrame) -> DataFrame:
    return sets.select(F.explode("toks").alias("tok")).groupBy("tok").agg(F.count(F.lit(1)).alias("f"))


def _ranked(frequent: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    got = frequent.toArrow()
    tok, f = got["tok"].to_numpy(), got["f"].to_numpy()
    rank = np.empty(len(tok), np.int64)
    rank[np.lexsort((tok, f))] = np.arange(1, len(tok) + 1)
    by = np.argsort(tok)
    return tok[by], rank[by]


def frequent(sets: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Frequent tokens of all sets (n, toks) and their ranks, at most MOST_FREQUENT.

    Each task counts its tokens in chunks and sends on those of a chunk that are
    more than its MOST_FREQUENTth part, so that tokens seen once or twice are not
    shuffled. A token of more than twice that part of all tokens is always
    found, one of less never.
    """

    def counted(held: list[np.ndarray]) -> pa.RecordBatch:
        tok, f = np.unique(np.concatenate(held), return_counts=True)
        ok = f > sum(map(len, held)) // MOST_FREQUENT
        return pa.RecordBatch.from_arrays([pa.array(tok[ok]), pa.array(f[ok])], names=["tok", "f"])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            held.append(batch.column(0).flatten().to_numpy(zero_copy_only=False))
            size += len(held[-1])
            if size >= COUNTED:
                yield counted(held)
                held, size = [], 0
        if size:
            yield counted(held)

    total = sets.agg(F.sum("n")).first()[0] or 0
    counts = sets.select("toks").mapInArrow(run, "tok long, f long").groupBy("tok").agg(F.sum("f").alias("f"))
    return _ranked(counts.where(F.col("f") > max(8, total // MOST_FREQUENT)))


def frequencies(sets: DataFrame) -> Frequencies:
    counts = materialize(_counted(sets).where("f > 1"), "df")
    total = sets.agg(F.sum(F.size("toks"))).first()[0] or 0
    seen, _ = key_bitmaps(counts, total, "tok")
    hot, rank = _ranked(counts.where(F.col("f") > max(8, total // MOST_FREQUENT)))
    release(counts)
    return Frequencies(seen, hot, rank)


def signature(toks: np.ndarray, size: int = SIG_WORDS) -> tuple[np.ndarray, int]:
    """The token bitmap as size words, and how many tokens share a bit with an earlier one."""
    bits = np.zeros(64 * size, np.uint8)
    bits[(_mix(toks.view(np.uint64)) % np.uint64(64 * size)).astype(np.int64)] = 1
    return np.packbits(bits).view(np.uint64), len(toks) - int(bits.sum())


def signatures(toks: np.ndarray, n: np.ndarray, size: int = SIG_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """signature of many sets of n tokens each, one after the other: a row of size words for each, and the shared bits."""
    bits = np.zeros((len(n), 64 * size), np.uint8)
    bits[np.repeat(np.arange(len(n)), n), (_mix(toks.view(np.uint64)) % np.uint64(64 * size)).astype(np.int64)] = 1
    return np.packbits(bits, axis=1).view(np.uint64), n - bits.sum(1, dtype=np.int64)


def wide_signature(toks: np.ndarray) -> np.ndarray:
    """A wider token bitmap, with the number of shared bits at its end."""
    sig, c = signature(toks, WIDE_WORDS)
    return np.r_[sig.view(np.int64), c]


def least_overlap(na, nb, t: float):
    """The least overlap of sets of sizes na and nb whose Jaccard similarity is t."""
    return np.ceil(t / (1 + t) * (na + nb) - 1e-9)


def _children(lo: np.ndarray, hi: np.ndarray, fan: int, size: np.ndarray):
    """For pairs of nodes, all pairs of their children."""
    a = (lo * fan)[:, None, None] + np.arange(fan)[None, :, None]
    b = (hi * fan)[:, None, None] + np.arange(fan)[None, None, :]
    a, b = np.broadcast_arrays(a, b)
    ok = (a < size) & (b < size) & (a <= b)
    return a[ok], b[ok]


class SignatureTree:
    """A packed tree over entries in order of block, size and bitmap.

    A node holds the ranges of its blocks and sizes, its OR-combined token
    bitmap and roles, and the most collisions below it. seen and kept count the
    node pairs that the traversal looked at and could not prune.
    """

    FAN = 8

    def __init__(self, key: np.ndarray, n: np.ndarray, c: np.ndarray, sig: np.ndarray, role: np.ndarray):
        self.order = np.lexsort((*sig.T, n, key))
        key, n, c, sig, role = key[self.order], n[self.order], c[self.order], sig[self.order], whole_role(role[self.order])
        self.levels = [(key, key, n, n, c, sig, role)]
        self.seen = self.kept = 0
        while len(self.levels[-1][0]) > 1:
            first, last, lo, hi, cm, s, r = self.levels[-1]
            at = np.arange(0, len(lo), self.FAN)
            end = np.minimum(at + self.FAN, len(lo)) - 1
            self.levels.append((first[at], last[end], np.minimum.reduceat(lo, at), np.maximum.reduceat(hi, at), np.maximum.reduceat(cm, at), np.bitwise_or.reduceat(s, at, axis=0), np.bitwise_or.reduceat(r, at)))

    def _possible(self, level: int, a: np.ndarray, b: np.ndarray, t: float) -> np.ndarray:
        first, last, lo, hi, cm, s, r = self.levels[level]
        # most pairs are of different blocks and end at once
        i = np.flatnonzero((first[b] <= last[a]) & (first[a] <= last[b]))
        x, y = a[i], b[i]
        at = (lo[y] * t <= hi[x] + 1e-9) & (lo[x] * t <= hi[y] + 1e-9) & joinable(r[x], r[y])
        i, x, y = i[at], x[at], y[at]
        most = np.bitwise_count(s[x] & s[y]).sum(1, dtype=np.int64) + np.minimum(cm[x], cm[y])
        ok = np.zeros(len(a), bool)
        ok[i] = most >= least_overlap(lo[x], lo[y], t)
        self.seen, self.kept = self.seen + len(a), self.kept + int(ok.sum())
        return ok

    def pairs(self, t: float, step: int = 1 << 13):
        """Index pairs of one block that may have similarity t, by a dual traversal from (root, root); yields arrays."""
        stack = [(len(self.levels) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))] if len(self.order) else []
        while stack:
            level, a, b = stack.pop()
            if level == 0:
                keep = a < b
                yield self.order[a[keep]], self.order[b[keep]]
                continue
            for i in range(0, len(a), step):
                x, y = _children(a[i : i + step], b[i : i + step], self.FAN, len(self.levels[level - 1][0]))
                ok = self._possible(level - 1, x, y, t)
                if ok.any():
                    stack.append((level - 1, x[ok], y[ok]))


#: roles: 1 may be the first of a pair, 2 the second (3 both); 4 and 8 the two sides of a pair of cells, 16 no cell; 32 new, 64 stored (96 both)
def whole_role(role: np.ndarray) -> np.ndarray:
    """role with its unstated bits, so that what a node's OR-combined role can't join, none of its entries can."""
    role = np.where(role & 12 == 0, role | 16, role)
    return np.where(role & 96 == 0, role | 96, role)


def joinable(ra: np.ndarray, rb: np.ndarray) -> np.ndarray:
    def meet(x: int, y: int) -> np.ndarray:
        return ((ra & x) != 0) & ((rb & y) != 0) | ((ra & y) != 0) & ((rb & x) != 0)

    return meet(1, 2) & meet(32, 64) & (meet(4, 8) | (ra & rb & 16 != 0))


def block_pairs(entries: DataFrame, t: float, keys: DataFrame | None = None, total: int = 0) -> DataFrame:
    """(a, b): pairs of classes (a < b) that share a block and may have similarity t, all of them found by dual traversal of signature trees.

    A task reads its entries in order of block, some CHUNK at a time, and holds
    one tree over them, whose nodes of different blocks prune each other. A
    block of more than HOT_BLOCK entries is a tree of tables first: it is cut
    into cells, the cells' upper nodes are traversed by joins, and each pair of
    cells left is a block of its own, so that no block sits in one task. keys:
    written tables of all entries' keys and perhaps more, some total; the entries
    are then written for large blocks only.
    """
    if keys is None:
        entries = keys = materialize(entries, "entries")
        total = keys.count()
    slot = F.col("key").bitwiseAND(F.lit((1 << (total // 512).bit_length()) - 1))
    # no block is larger than its slot, so that keys are counted one by one in the large slots only
    large = [r.slot for r in keys.groupBy(slot.alias("slot")).agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > HOT_BLOCK).collect()]
    if large:
        entries = materialize(entries, "entries") if entries is not keys else entries
        slots = entries.sparkSession.createDataFrame([(x,) for x in large], "slot long")
        hot = entries.select("key", slot.alias("slot")).join(F.broadcast(slots), "slot", "left_semi").groupBy("key").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > HOT_BLOCK)
        hot = materialize(hot, "hot")
        if hot.limit(1).count():
            entries = entries.join(hot, "key", "left_anti").unionByName(_cells(entries.join(hot.drop("m"), "key", "left_semi"), t))

    def solve(got: pa.Table):
        key, cid, n, c, role = (got.column(i).to_numpy() for i in range(5))
        sig = np.stack([got.column(5 + i).to_numpy().view(np.uint64) for i in range(SIG_WORDS)], 1)
        found = [np.empty((0, 2), np.int64)]
        for a, b in SignatureTree(key, n.astype(np.int64), c.astype(np.int64), sig, role.astype(np.int64)).pairs(t):
            x, y = np.minimum(cid[a], cid[b]), np.maximum(cid[a], cid[b])
            found.append(np.stack([x, y], 1)[x < y])
            if len(found) > 100:
                found[:] = [np.unique(np.concatenate(found), axis=0)]
        out = np.unique(np.concatenate(found), axis=0)
        for i in range(0, len(out), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(out[i : i + (1 << 16), 0]), pa.array(out[i : i + (1 << 16), 1])], names=["a", "b"])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += batch.num_rows
            if size >= CHUNK:
                got = pa.Table.from_batches(held).combine_chunks()
                key = got.column(0).to_numpy()
                # the last block may go on in the next batch
                end = int(np.searchsorted(key, key[-1]))
                if end:
                    yield from solve(got.slice(0, end))
                    held, size = got.slice(end).to_batches(), len(got) - end
        if held:
            yield from solve(pa.Table.from_batches(held))

    return entries.repartition("key").sortWithinPartitions("key").mapInArrow(run, "a long, b long").distinct()


def _cells(entries: DataFrame, t: float) -> DataFrame:
    """The entries of large blocks as blocks of pairs of cells.

    A cell holds entries of one size band. Cells are the leaves of a tree whose
    nodes are rows of tables (CELL_FAN cells or nodes to a node of a band). The
    tree is traversed against itself from the bands downwards, level by level:
    each step is a join on the parent node, so that a block's pairs are spread.
    """
    band = F.floor(F.log(F.col("n").cast("double")) / F.lit(0.14)).cast("int")
    reach = int(np.ceil(-np.log(t) / 0.14)) + 1
    sized = entries.withColumn("band", band)
    parts = sized.groupBy("key", "band").agg(F.ceil(F.count(F.lit(1)) / CELL).cast("int").alias("parts"))
    sized = materialize(sized.join(parts, ["key", "band"]).withColumn("sub", F.pmod(F.xxhash64("cid"), F.col("parts")).cast("int")).drop("parts"), "cells")
    sig = [f"s{i}" for i in range(SIG_WORDS)]
    nodes = [materialize(sized.groupBy("key", "band", F.col("sub").alias("node")).agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.max("c").alias("c"), *[F.bit_or(s).alias(s) for s in sig]), "nodes")]
    most = nodes[0].agg(F.max("node")).first()[0]
    while most:
        upper = nodes[-1].groupBy("key", "band", F.floor(F.col("node") / CELL_FAN).cast("int").alias("node")).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.max("c").alias("c"), *[F.bit_or(s).alias(s) for s in sig])
        nodes.append(materialize(upper, "nodes"))
        most //= CELL_FAN
    overlap = sum((F.bit_count(F.col(f"a_{s}").bitwiseAND(F.col(f"b_{s}"))) for s in sig), F.lit(0)) + F.least("a_c", "b_c")
    ids = ["key", "a_band", "a_node", "b_band", "b_node"]

    def side(level: int, x: str) -> DataFrame:
        return nodes[level].select("key", F.floor(F.col("node") / CELL_FAN).cast("int").alias(f"{x}_up"), *[F.col(c).alias(f"{x}_{c}") for c in nodes[level].columns if c != "key"])

    def possible(pairs: DataFrame) -> DataFrame:
        ordered = F.struct("a_band", "a_node") <= F.struct("b_band", "b_node")
        close = (F.col("b_band") - F.col("a_band") <= reach) & (F.col("b_lo") * t <= F.col("a_hi") + 1e-9) & (F.col("a_lo") * t <= F.col("b_hi") + 1e-9)
        return pairs.where(ordered & close & (overlap >= F.ceil(t / (1 + t) * (F.col("a_lo") + F.col("b_lo")) - 1e-9))).select(*ids)

    # one node for each band at the top
    top = len(nodes) - 1
    pairs = materialize(possible(side(top, "a").join(side(top, "b"), "key")), "cellpairs")
    for level in range(top - 1, -1, -1):
        up = pairs.withColumnsRenamed({"a_node": "a_up", "b_node": "b_up"})
        pairs = materialize(possible(up.join(side(level, "a"), ["key", "a_band", "a_up"]).join(side(level, "b"), ["key", "b_band", "b_up"])), "cellpairs")
    same = (F.col("a_band") == F.col("b_band")) & (F.col("a_node") == F.col("b_node"))
    pairs = pairs.select("*", F.xxhash64(*ids).alias("cell"), same.alias("same"))
    out = None
    for x, bit in (("a", 4), ("b", 8)):
        p = pairs.select("key", F.col(f"{x}_band").alias("band"), F.col(f"{x}_node").alias("sub"), "cell", "same")
        p = p if x == "a" else p.where(~F.col("same"))
        rows = sized.join(p, ["key", "band", "sub"]).select(
            F.col("cell").alias("key"), "cid", "n", "c", F.when(F.col("same"), F.col("role")).otherwise(F.col("role").bitwiseOR(F.lit(bit))).cast("int").alias("role"), *sig
        )
        out = rows if out is None else out.unionByName(rows)
    return out


def verified(pairs: DataFrame, sets: DataFrame, t: float) -> DataFrame:
    """(a, b, distance, sim): the pairs whose sets (cid, n, toks, wide) have similarity t; toks may lack tokens that only one set holds, n counts them.

    As strings in hash order the sets are distance insertions and deletions
    apart; a similarity of t allows (1 - t) / (1 + t) of both lengths. Pairs
    whose wide bitmaps show a greater distance end there, before the strings
    are fetched. The pairs are few beside the sets and hashed, which spares
    sorting sets.
    """
    side = lambda x, *cs: sets.select(F.col("cid").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in cs])
    total = F.col("n_a") + F.col("n_b")
    bound = F.floor((1 - t) / (1 + t) * F.col("total") + 1e-9)
    both = F.zip_with(F.slice("wide_a", 1, WIDE_WORDS), F.slice("wide_b", 1, WIDE_WORDS), lambda x, y: F.bit_count(x.bitwiseAND(y)))
    most = F.aggregate(both, F.lit(0), lambda s, x: s + x) + F.least(F.element_at("wide_a", WIDE_WORDS + 1), F.element_at("wide_b", WIDE_WORDS + 1))
    hashed = lambda df: df.hint("shuffle_hash")
    close = hashed(hashed(pairs).join(side("a", "n", "wide"), "a")).join(side("b", "n", "wide"), "b").select("a", "b", total.alias("total"), most.alias("most"))
    close = close.where(F.col("total") - 2 * F.col("most") <= bound).select("a", "b", "total")
    met = hashed(close).join(side("a", "toks"), "a").join(side("b", "toks"), "b").select("a", "b", "total", "toks_a", "toks_b")

    def run(batches):
        for batch in batches:
            total = batch.column(2).to_numpy().astype(np.int64)
            (u, x), (v, y) = ((c.values.to_numpy(zero_copy_only=False), c.offsets.to_numpy()) for c in (batch.column(3), batch.column(4)))
            shared = [len(np.intersect1d(u[x[i] : x[i + 1]], v[y[i] : y[i + 1]], assume_unique=True)) for i in range(len(total))]
            distance = total - 2 * np.array(shared, np.int64)
            sim = (total - distance) / (total + distance)
            ok = pa.array((distance <= np.floor((1 - t) / (1 + t) * total + 1e-9)) & (sim >= t))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(distance), pa.array(sim)], names=["a", "b", "distance", "sim"]).filter(ok)

    return met.mapInArrow(run, "a long, b long, distance long, sim double")
