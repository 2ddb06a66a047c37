"""Problem 9: filling containers of fixed capacity, by hierarchical residual packing.

Every task packs its own items best-fit by falling size and gives out the bins
that are nearly full. The rest become items of the next round, packed by fewer
tasks, until one task holds them all or a round saves nothing. A task holds at
most BLOCK items at once, so no round gathers an unbounded group.

Only an item above the capacity is split: into full pieces and a remainder.

Defined results: items without size (null, zero) take no place and give no row;
ties are broken by item; an empty table gives no row. Each row id must be
unique, as container names come from it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.plans.tables import materialize

BLOCK = 50_000
MEMBER = "struct<item:long,part:int,start:long,tokens:int>"
BINS = f"size int, members array<{MEMBER}>, full boolean"


def best_fit(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins of indices: best fit by falling size. The bits of an integer mark the residuals that have an open bin."""
    bins: list[list[int]] = []
    open_by: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        above = mask >> size
        if above:
            r = size + (above & -above).bit_length() - 1
            b = open_by[r].pop()
            if not open_by[r]:
                mask &= ~(1 << r)
            bins[b].append(i)
        else:
            r, b = capacity, len(bins)
            bins.append([i])
        r -= size
        if r:
            open_by[r].append(b)
            mask |= 1 << r
    return bins


def _round(capacity: int, slack: int, last: bool):
    kind = pa.list_(pa.struct([("item", pa.int64()), ("part", pa.int32()), ("start", pa.int64()), ("tokens", pa.int32())]))

    def pack(sizes, members):
        sizes = np.array(sizes, np.int64)
        out = [(int(sizes[b].sum()), [m for i in b for m in members[i]]) for b in best_fit(sizes, capacity)]
        for lo in range(0, len(out), 5000):
            s, m = zip(*out[lo : lo + 5000])
            full = [last or x >= capacity - slack for x in s]
            yield pa.RecordBatch.from_arrays([pa.array(s, pa.int32()), pa.array(m, kind), pa.array(full)], names=["size", "members", "full"])

    def run(batches):
        sizes, members = [], []
        for batch in batches:
            sizes += batch.column(0).to_pylist()
            members += batch.column(1).to_pylist()
            while len(sizes) >= BLOCK:
                yield from pack(sizes[:BLOCK], members[:BLOCK])
                sizes, members = sizes[BLOCK:], members[BLOCK:]
        if sizes:
            yield from pack(sizes, members)

    return run


def containers(sizes: DataFrame, row_id: str, size: str, capacity: int = 2048, slack: float = 0.005, fan: int = 8) -> DataFrame:
    """(row_id, part, start, tokens, container, used): each piece of each item in its container; start counts from the item's beginning."""
    s = F.col(size).cast("long")
    whole = sizes.where(s > 0).select(F.col(row_id).cast("long").alias("item"), s.alias("n"))
    pieces = whole.select("item", F.col("n"), F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / capacity).cast("int"))).alias("part"))
    start = F.col("part").cast("long") * capacity
    pieces = pieces.select(F.least(F.lit(capacity), F.col("n") - start).cast("int").alias("size"), F.array(F.struct("item", "part", start.alias("start"), F.least(F.lit(capacity), F.col("n") - start).cast("int").alias("tokens"))).alias("members"))
    pieces = materialize(pieces, "pieces")
    near = max(0, int(capacity * slack))
    level = materialize(pieces.mapInArrow(_round(capacity, near, False), BINS), "bins")
    out, rest, tasks = level.where("full"), level.where("not full"), pieces.rdd.getNumPartitions()
    left = rest.count()
    while left:
        tasks = min(-(-left // BLOCK), max(1, tasks // fan))
        if tasks * BLOCK < left:
            tasks = -(-left // BLOCK)
        level = materialize(rest.select("size", "members").repartition(tasks).mapInArrow(_round(capacity, near, tasks == 1 and left <= BLOCK), BINS), "bins")
        out, rest = out.unionByName(level.where("full")), level.where("not full")
        now = rest.count()
        if now and now > 0.98 * left and tasks > 1:
            out = out.unionByName(rest)
            break
        left = now
    first = F.array_min(F.transform("members", lambda m: F.struct(m["item"], m["part"])))
    name = F.concat_ws("-", first["item"].cast("string"), first["part"].cast("string"))
    return out.select("size", name.alias("container"), F.explode("members").alias("m")).select(
        F.col("m.item").alias(row_id), "m.part", "m.start", "m.tokens", "container", F.col("size").alias("used")
    )
