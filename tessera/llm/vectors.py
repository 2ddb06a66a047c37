"""Problem 5: the most similar vectors of every vector, by robust-pruned directed graphs.

Equal vectors of one space (provider, model, dimension) are one class. The
classes of a space are spread over shards of about CAPACITY by nearest centre
(centres are fitted on a bounded sample; every class is stored; a shard that
draws far more is cut by hash, and its queries go to every part). Each shard
builds a directed graph: batches of greedy searches propose neighbours, and
relaxed distance pruning keeps diverse edges. Every class is searched by beam
in its PROBES nearest shards, for each of its items apart: classes that hold
nothing but the asking item are passed over before candidates are cut, shards
that hold nothing else aren't counted, and where the item's own vectors fill
the beam, the shard's others are compared one by one. Where a least similarity
is wanted, a shard's graph is searched only for those classes of other shards
that reach it there, as a product with all its vectors tells. What the graphs find is
turned into rows again: for each class and item its nearest rows of other items.

Approximate: recall against brute force is measured by the tests.

Defined results: vectors that are null, of another length than their dimension,
all zero or with values not finite are left out; null keys are keys of their
own; copies within an item are no neighbours of each other; ties go to the
smaller id; an empty table gives no row. Similarities are cosines in double
precision.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.plans.tables import materialize, scratch

#: vectors of a shard; shards that a query is sent to; vectors that fit a space's centres, and most centres of a space
CAPACITY, PROBES, SAMPLE, MOST_CENTRES = 16_000, 4, 10_000, 1_000
DEGREE, BEAM, RELAX, WIDTH = 32, 64, 1.44, 4
#: nodes whose distances every search begins with, and how many of the nearest it starts at
ENTRIES, STARTS = 2048, 16
#: queries that a shard is asked at once; of these, those that walk its graph together
QUERIES, TOGETHER = 4096, 128
#: a beam's place as one number that sorts by distance: 32 bits of distance, 31 of node, one set once its edges are followed; a free place
FOLLOWED, NONE = np.uint64(1), np.uint64(2**64 - 2)


def _keys(node: np.ndarray, dist: np.ndarray) -> np.ndarray:
    return np.maximum(dist, np.float32(0)).view(np.uint32).astype(np.uint64) << np.uint64(32) | node.astype(np.uint64) << np.uint64(1)


def _nodes(keys: np.ndarray) -> np.ndarray:
    return ((keys & np.uint64(2**32 - 1)) >> np.uint64(1)).astype(np.int64)


class Graph:
    """A navigable graph over unit vectors."""

    def __init__(self, x: np.ndarray, seed: int = 7):
        self.x = np.ascontiguousarray(x, np.float32)
        n = len(x)
        rng = np.random.default_rng(seed)
        self.edges = np.full((n, DEGREE), -1, np.int32)
        order = rng.permutation(n).astype(np.int32)
        first = order[: min(n, 256)]
        near = -(self.x[first] @ self.x[first].T)
        np.fill_diagonal(near, np.inf)
        by = np.argsort(near, 1, kind="stable")[:, : BEAM + 16]
        self.edges[first] = self._prune(first, first[by], np.take_along_axis(near, by, 1) * 2 + 2)
        self.entries = order[:ENTRIES]
        at = len(first)
        while at < n:
            new = order[at : at + min(at, 2048)]
            ids, dist = self.search(self.x[new], BEAM, reach=at)
            self.edges[new] = self._prune(new, ids, dist)
            self._tie_back(new)
            at += len(new)

    def _prune(self, p: np.ndarray, cand: np.ndarray, dist: np.ndarray) -> np.ndarray:
        """Robust pruning: of each row's candidates (by rising distance, -1 for none) at most DEGREE such that none is much nearer to a kept one."""
        out = np.full((len(p), DEGREE), -1, np.int32)
        for lo in range(0, len(p), 512):
            c, d = cand[lo : lo + 512], np.where((cand[lo : lo + 512] < 0) | (cand[lo : lo + 512] == p[lo : lo + 512, None]), np.inf, dist[lo : lo + 512])
            v = self.x[np.maximum(c, 0)]
            between = 2 - 2 * (v @ v.transpose(0, 2, 1))
            alive, rows = np.isfinite(d), np.arange(len(c))
            for k in range(DEGREE):
                best = np.where(alive, d, np.inf).argmin(1)
                ok = alive[rows, best]
                if not ok.any():
                    break
                out[lo + rows[ok], k] = c[ok, best[ok]]
                alive &= ~((RELAX * between[rows, best] <= d) & ok[:, None])
                alive[rows, best] = False
        return out

    def _tie_back(self, new: np.ndarray) -> None:
        """Add the reverse of the new edges, pruning where they are too many."""
        src = np.repeat(new, DEGREE)
        dst = self.edges[new].ravel()
        src, dst = src[dst >= 0], dst[dst >= 0]
        d = 2 - 2 * np.einsum("ij,ij->i", self.x[src], self.x[dst])
        by = np.lexsort((d, dst))
        src, dst = src[by], dst[by]
        start = np.flatnonzero(np.r_[True, dst[1:] != dst[:-1]])
        place = np.arange(len(dst)) - np.repeat(start, np.diff(np.r_[start, len(dst)]))
        # the nearest of the new ones; those beyond are found through them
        keep = place < BEAM
        node = dst[start]
        extra = np.full((len(node), BEAM), -1, np.int32)
        extra[np.searchsorted(node, dst[keep]), place[keep]] = src[keep]
        both = np.concatenate([self.edges[node], extra], 1)
        count = (both >= 0).sum(1)
        fits = count <= DEGREE
        packed = np.take_along_axis(both, np.argsort(both < 0, 1, kind="stable"), 1)
        self.edges[node[fits]] = packed[fits][:, :DEGREE]
        if (~fits).any():
            node, both = node[~fits], packed[~fits]
            for lo in range(0, len(node), 512):
                p, c = node[lo : lo + 512], both[lo : lo + 512]
                d = np.where(c < 0, np.inf, 2 - 2 * np.einsum("ij,ikj->ik", self.x[p], self.x[np.maximum(c, 0)]))
                by = np.argsort(d, 1, kind="stable")
                self.edges[p] = self._prune(p, np.take_along_axis(c, by, 1), np.take_along_axis(d, by, 1))

    def search(self, q: np.ndarray, beam: int, start: np.ndarray | None = None, reach: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """For each query the nearest nodes found (-1 where fewer) and their squared distances, by rising distance.

        The beam starts at the nearest of the entries, and at a node known to be
        near, as the query's own, where there is one (start, -1 for none).
        reach: only so many of the entries are in the graph yet.
        """
        ids, dist = np.full((len(q), beam), -1, np.int32), np.full((len(q), beam), np.inf, np.float32)
        for lo in range(0, len(q), TOGETHER):
            at = slice(lo, lo + TOGETHER)
            ids[at], dist[at] = self._beam(np.ascontiguousarray(q[at], np.float32), beam, self.entries[:reach], None if start is None else start[at])
        return ids, dist

    def _beam(self, q: np.ndarray, beam: int, entries: np.ndarray, start: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        m, e, bits = len(q), min(len(entries), beam - 1, STARTS), len(self.x).bit_length()
        far = 2 - 2 * (q @ self.x[entries].T)
        near = np.argpartition(far, e - 1, 1)[:, :e]
        held, met = np.full((m, beam), NONE), np.zeros(m << bits, bool)  # met: (query, node), whether compared
        held[:, :e] = _keys(entries[near], np.take_along_axis(far, near, 1))
        met[(np.arange(m)[:, None] << bits) + entries[near]] = True
        if start is not None:
            r = np.flatnonzero(start >= 0)
            r = r[~met[(r << bits) + start[r]]]
            held[r, e] = _keys(start[r], 2 - 2 * np.einsum("ij,ij->i", q[r], self.x[start[r]]))
            met[(r << bits) + start[r]] = True
        held.sort(1)
        flat = held.reshape(-1)
        while True:
            todo = (held & FOLLOWED == 0) & (held != NONE)
            todo &= np.cumsum(todo, 1, dtype=np.int32) <= WIDTH
            place = np.flatnonzero(todo)
            if not len(place):
                break
            flat[place] |= FOLLOWED
            to = self.edges.take(_nodes(flat[place]), 0)
            at = (to + (place // beam << bits)[:, None])[to >= 0]
            at = np.sort(at[~met.take(at)])
            at = at[np.diff(at, prepend=-1) > 0]
            met[at] = True
            r, node = at >> bits, at & ((1 << bits) - 1)
            new = _keys(node, 2 - 2 * np.einsum("ij,ij->i", q.take(r, 0), self.x.take(node, 0)))
            ok = new < held[:, -1].take(r)
            r, new = r[ok], new[ok]
            if not len(r):
                continue
            count = np.bincount(r, minlength=m)
            rows = np.flatnonzero(count)
            both = np.full((len(rows), beam + count.max()), NONE)
            both[:, :beam] = held[rows]
            both[np.repeat(np.arange(len(rows)), count[rows]), beam + np.arange(len(r)) - (np.cumsum(count) - count)[r]] = new
            both.sort(1)
            held[rows] = both[:, :beam]
        none = held == NONE
        return np.where(none, -1, _nodes(held)).astype(np.int32), np.where(none, np.float32(np.inf), (held >> np.uint64(32)).astype(np.uint32).view(np.float32))


def usable(df: DataFrame, row_id: str, space: list[str], dimension: str, vector: str, item: list[str]) -> DataFrame:
    """(row, space, item, vector): the vectors that can be compared."""
    v = F.col(vector)
    good = v.isNotNull() & (F.size(v) == F.col(dimension)) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return df.where(good).select(F.col(row_id).cast("long").alias("row"), F.struct(*space, dimension).alias("space"), F.struct(*item).alias("item"), v.cast("array<double>").alias("vector"))


def _unit(vectors: list) -> np.ndarray:
    x = np.array(vectors, np.float64)
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _centres(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    c = x[np.random.default_rng(3).choice(len(x), k, replace=False)]
    for _ in range(rounds):
        near = (x @ c.T).argmax(1)
        for j in range(k):
            if (near == j).any():
                s = x[near == j].sum(0)
                c[j] = s / (np.linalg.norm(s) or 1)
    return c


def _matrix(column: pa.Array, rows: list[int]) -> np.ndarray:
    """The rows of a column of equally long lists."""
    return column.take(pa.array(rows)).flatten().to_numpy().reshape(len(rows), -1)


def _spaces(space: pa.Array) -> dict[str, list[int]]:
    groups: dict = {}
    for i, s in enumerate(space.to_pylist()):
        groups.setdefault(s, []).append(i)
    return groups


def _homes(classes: DataFrame, capacity: int) -> tuple[DataFrame, dict, int]:
    """(space, cls, items, vector, shard) with unit vectors and home shards; of each space its first shard, their number and centres; all shards."""
    spark = classes.sparkSession
    sizes = classes.groupBy(F.to_json("space").alias("space")).agg(F.count(F.lit(1)).alias("n")).collect()  # one row for each model
    centres, base = {}, 0
    for r in sizes:
        k = min(-(-r["n"] // capacity), MOST_CENTRES)
        name, c = r["space"], None
        if k > 1:
            sample = classes.where(F.to_json("space") == name)
            c = _centres(_unit(sample.orderBy(F.xxhash64("cls")).limit(SAMPLE).toArrow()["vector"].to_pylist()), k)
        centres[name] = (base, k, c)
        base += k
    shared = spark.sparkContext.broadcast(centres)

    def run(batches):
        for batch in batches:
            space, cls, items, vec = (batch.column(i) for i in range(4))
            for s, rows in _spaces(space).items():
                first, _, c = shared.value[s]
                x, at = _unit(_matrix(vec, rows)), pa.array(rows)
                home = (x @ c.T).argmax(1) if c is not None else np.zeros(len(rows), int)
                yield pa.RecordBatch.from_arrays(
                    [space.take(at), cls.take(at), items.take(at), pa.array(list(x.astype(np.float32)), pa.list_(pa.float32())), pa.array((first + home).astype(np.int32))],
                    names=["space", "cls", "items", "vector", "shard"],
                )

    homes = classes.select(F.to_json("space").alias("space"), "cls", "items", "vector").mapInArrow(run, "space string, cls long, items array<long>, vector array<float>, shard int")
    return homes, centres, base


def _routes(homes: DataFrame, centres: dict, probes: int, enough: int) -> DataFrame:
    """(shard, home, cls, items, vector): each class at its home shard and, as a query, at the nearest shards.

    Shards that hold nothing but the query's item aren't counted, and where the
    item has most of a shard, further ones follow until enough others are met.
    """
    owner = F.when(F.size("items") == 1, F.col("items")[0]).alias("owner")
    most = homes.groupBy("shard", owner).agg(F.count(F.lit(1)).alias("n")).groupBy("shard")
    most = most.agg(F.sum("n").alias("n"), F.max(F.when(F.col("owner").isNotNull(), F.struct("n", "owner"))).alias("top"))
    held = {r["shard"]: (r["n"], r["top"]) for r in most.collect()}  # one row for each shard
    shared = homes.sparkSession.sparkContext.broadcast((centres, held))

    def run(batches):
        centres, held = shared.value
        ruling = {t["owner"] for n, t in held.values() if t and 2 * t["n"] > n}
        for batch in batches:
            space, cls, items, vec, shard = (batch.column(i) for i in range(5))
            asked = items.to_pylist()
            for s, rows in _spaces(space).items():
                first, k, c = centres[s]
                home = shard.to_numpy()[rows] - first
                near = np.argsort(-(_matrix(vec, rows) @ c.T.astype(np.float32)), 1, kind="stable") if c is not None else np.zeros((len(rows), 1), int)
                go = np.zeros((len(rows), k), bool)
                np.put_along_axis(go, near[:, :probes], True, 1)
                wide: dict = {}
                for i, r in enumerate(rows):
                    for item in asked[r]:
                        if item in ruling:
                            wide.setdefault(item, []).append(i)
                for item, own in wide.items():
                    others = np.array([n - (t["n"] if t and t["owner"] == item else 0) for n, t in (held.get(first + j, (0, None)) for j in range(k))])
                    met = others[near[own]]
                    visit = (met > 0) & ((np.cumsum(met > 0, 1) <= probes) | (np.cumsum(met, 1) - met < enough))
                    more = np.zeros_like(visit)
                    np.put_along_axis(more, near[own], visit, 1)
                    go[own] |= more
                go[np.arange(len(rows)), home] = True
                row, to = np.nonzero(go)
                at = pa.array(np.array(rows)[row])
                yield pa.RecordBatch.from_arrays(
                    [pa.array((first + to).astype(np.int32)), pa.array(to == home[row]), cls.take(at), items.take(at), vec.take(at)],
                    names=["shard", "home", "cls", "items", "vector"],
                )

    return homes.mapInArrow(run, "shard int, home boolean, cls long, items array<long>, vector array<float>")


class Shard:
    """The graph of a shard's own classes (ids, items, unit vectors), asked by batches of queries."""

    def __init__(self, ids: np.ndarray, items: list, x: np.ndarray):
        self.ids, self.graph = ids, Graph(x)
        self.sole = np.array([i[0] if len(i) == 1 else 0 for i in items], np.int64)
        self.single = np.array([len(i) == 1 for i in items])

    def _hopeful(self, node: np.ndarray, x: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the queries that can find something, and each query's node to start at (-1 for none).

        What comes from other shards is first multiplied with all vectors here:
        where none reaches least the search could only come back empty, and
        elsewhere it starts at the nearest, too. Nothing is lost by that, and
        the product costs less than a search as long as shards are bounded.
        """
        some, start = np.ones(len(node), bool), node.copy()
        if least > -1:
            away = np.flatnonzero(node < 0)
            for p in (away[i : i + 256] for i in range(0, len(away), 256)):
                near = x[p] @ self.graph.x.T
                some[p] = near.max(1) >= least - 2e-4
                start[p[some[p]]] = near[some[p]].argmax(1)
        return np.flatnonzero(some), start

    def candidates(self, ids: np.ndarray, node: np.ndarray, x: np.ndarray, items: list, keep: int, least: float):
        """(query position, asking item or 0, whether there is one, node, similarity): for each query and item the keep nearest nodes of others found. node: the query's own, or -1."""
        some, start = self._hopeful(node, x, least)
        found, dist = np.full((len(x), max(BEAM, keep + 1)), -1, np.int32), np.full((len(x), max(BEAM, keep + 1)), np.inf, np.float32)
        found[some], dist[some] = self.graph.search(x[some], max(BEAM, keep + 1), start[some])
        each = [(i, a, bool(items[i])) for i in some.tolist() for a in (items[i] or [0])]
        q, asks, has = np.array([e[0] for e in each]), np.array([e[1] for e in each], np.int64), np.array([e[2] for e in each])
        for at in (slice(i, i + 8192) for i in range(0, len(q), 8192)):
            f, near = found[q[at]], 1 - dist[q[at]] / 2
            n = np.maximum(f, 0)
            close = (f >= 0) & (near >= least - 1e-4)
            theirs = close & has[at, None] & self.single[n] & (self.sole[n] == asks[at, None])
            ok = close & ~theirs & (self.ids[n] != ids[q[at], None])
            # the item's own vectors took the places of others
            short = theirs.any(1) & (ok.sum(1) < keep) & (close[:, -1] | (f[:, -1] < 0))
            ok &= (np.cumsum(ok, 1) <= keep) & ~short[:, None]
            r, c = np.nonzero(ok)
            yield q[at][r], asks[at][r], has[at][r], f[r, c], near[r, c]
            short = np.flatnonzero(short) + at.start
            for item in np.unique(asks[short]):
                others = np.flatnonzero(~(self.single & (self.sole == item)))
                if not len(others):
                    continue
                of, xs = short[asks[short] == item], self.graph.x[others]
                for i in range(0, len(of), 1024):
                    p = of[i : i + 1024]
                    near = x[q[p]] @ xs.T
                    near[self.ids[others][None] == ids[q[p], None]] = -np.inf
                    m = min(keep, len(others))
                    top = np.argpartition(-near, m - 1, 1)[:, :m]
                    near = np.take_along_axis(near, top, 1)
                    r, c = np.nonzero(near >= least - 1e-4)
                    yield q[p][r], asks[p][r], has[p][r], others[top[r, c]], near[r, c]


def nearest_classes(classes: DataFrame, keep: int, least: float, capacity: int = CAPACITY, probes: int = PROBES) -> DataFrame:
    """(a, asker, b): for each class and each of its items (null where none are given) the keep most similar classes found that hold another item, of similarity least or more (a little slack for rounding)."""
    homes, centres, shards = _homes(classes, capacity)
    homes = materialize(homes, "homes")
    routed = materialize(_routes(homes, centres, probes, 10 * keep), "routed")
    # a shard that drew more than its share is cut by hash; its queries go to every part
    parts = homes.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / (1.5 * capacity)).cast("int").alias("parts"))
    routed = routed.join(parts, "shard").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    home = F.col("home") & (F.pmod(F.xxhash64("cls"), F.col("parts")) == F.col("part"))
    routed = routed.select((F.col("shard").cast("long") * 1_000_000 + F.col("part")).alias("shard"), home.alias("home"), "cls", "items", "vector")

    def ask(shard, ids, node, x, items):
        for lo in range(0, len(ids), QUERIES):
            at = slice(lo, lo + QUERIES)
            for q, item, has, n, near in shard.candidates(ids[at], node[at], x[at], items[at], keep, least):
                yield pa.RecordBatch.from_arrays([pa.array(ids[at][q]), pa.array(item, mask=~has), pa.array(shard.ids[n]), pa.array(near.astype(np.float64))], names=["a", "asker", "b", "near"])

    def run(batches):
        name = shard = None
        held: list = []

        def taken():
            """The rows held, as ids, items and vectors."""
            rows, held[:] = list(held), []
            return np.array([r[0] for r in rows], np.int64), [r[1] for r in rows], np.array([r[2] for r in rows], np.float32)

        def settle():
            """Build the graph of a shard whose own classes are held, and ask for them; or ask what is held of a built one."""
            nonlocal shard
            ids, items, x = taken()
            if shard is None:
                shard = Shard(ids, items, x)
                yield from ask(shard, ids, np.arange(len(ids), dtype=np.int32), shard.graph.x, items)
            else:
                yield from ask(shard, ids, np.full(len(ids), -1, np.int32), x, items)

        # a shard's own classes come first, then the queries from other shards, some at a time
        for batch in batches:
            for s, h, c, i, v in zip(*(batch.column(i).to_pylist() for i in range(4)), batch.column(4)):
                if s != name:
                    if held:
                        yield from settle()
                    name, shard = s, None
                if not h:
                    if shard is None and not held:
                        continue  # nothing to find here
                    if shard is None or len(held) >= QUERIES:
                        yield from settle()
                held.append((c, i, v.values.to_numpy()))
        if held:
            yield from settle()

    found = routed.repartitionByRange(max(1, shards), "shard").sortWithinPartitions("shard", F.desc("home"), "cls").mapInArrow(run, "a long, asker long, b long, near double")
    found = found.groupBy("a", "asker", "b").agg(F.max("near").alias("near"))
    w = Window.partitionBy("a", "asker").orderBy(F.desc("near"), "b")
    return found.withColumn("k", F.row_number().over(w)).where(F.col("k") <= keep).select("a", "asker", "b")


def cosine(a, b):
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, z: s + z)
    return dot(a, b) / F.sqrt(dot(a, a)) / F.sqrt(dot(b, b))


def neighbours(vectors: DataFrame, k: int = 10, least: float = -1.0, capacity: int = CAPACITY, probes: int = PROBES, keep: int = 40) -> DataFrame:
    """(row, other, similarity): of usable vectors, the k most similar rows of other items in the same space, as far as least."""
    with scratch() as kept:
        same = F.struct(F.xxhash64("space", "vector").alias("x"), F.xxhash64("vector", F.lit(1), "space").alias("y"))
        rows = materialize(vectors.withColumn("same", same), "vectors")
        classes = materialize(rows.groupBy("same").agg(F.min("row").alias("cls"), F.first("space").alias("space"), F.first("vector").alias("vector")), "classes")
        members = materialize(rows.join(classes.select("same", "cls"), "same").select("cls", "row", "item", F.xxhash64(F.to_json("item")).alias("asker")), "members")
        # a class of more than k items gives each of them k rows of others at similarity 1 and asks for none of them apart
        held = members.select("cls", "asker").distinct().withColumn("i", F.row_number().over(Window.partitionBy("cls").orderBy("asker"))).where(F.col("i") <= k + 1)
        held = held.groupBy("cls").agg(F.collect_list("asker").alias("items")).withColumn("items", F.when(F.size("items") <= k, F.col("items")).otherwise(F.array().cast("array<bigint>")))
        pairs = materialize(nearest_classes(classes.join(held, "cls").select("cls", "space", "items", "vector"), keep, least, capacity, probes), "pairs")
        va, vb = (classes.select(F.col("cls").alias(x), F.col("vector").alias(f"v{x}")) for x in "ab")
        near = pairs.join(va, "a").join(vb, "b").select("a", "asker", "b", cosine(F.col("va"), F.col("vb")).alias("similarity")).where(F.col("similarity") >= least)
        # of each class the first k rows of each of its first k + 1 items: enough for any item's k nearest
        by_item = Window.partitionBy("cls", "item").orderBy("row")
        some = members.withColumn("i", F.row_number().over(by_item)).where(F.col("i") <= k)
        heads = some.where("i = 1").withColumn("j", F.row_number().over(Window.partitionBy("cls").orderBy("row"))).where(F.col("j") <= k + 1).select("cls", "item")
        reps = materialize(some.join(heads, ["cls", "item"]).select(F.col("cls").alias("b"), F.col("row").alias("other"), F.col("item").alias("theirs")), "reps")
        near = near.unionByName(classes.select(F.col("cls").alias("a"), F.lit(None).cast("long").alias("asker"), F.col("cls").alias("b"), F.lit(1.0).alias("similarity")))
        askers = members.select(F.col("cls").alias("a"), "item", F.col("asker").alias("who")).distinct()
        w = Window.partitionBy("a", "item").orderBy(F.desc("similarity"), "other")
        best = near.join(reps, "b").join(askers, "a").where((F.col("asker").isNull() | (F.col("asker") == F.col("who"))) & ~F.col("item").eqNullSafe(F.col("theirs"))).withColumn("k", F.row_number().over(w)).where(F.col("k") <= k)
        out = members.withColumnRenamed("cls", "a").alias("m").join(best.alias("n"), (F.col("m.a") == F.col("n.a")) & F.col("m.item").eqNullSafe(F.col("n.item"))).select("m.row", "other", "similarity")
        kept.append(out := materialize(out, "neighbours"))
    return out
