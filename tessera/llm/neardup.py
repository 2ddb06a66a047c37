"""Problem 3: near-duplicate records with small edits, by signature trees.

Classes of equal contents are cut into word shingles. Two sets of similarity t
share one of their first n - ceil(t n) + 1 tokens in any common order; here
tokens seen once come first (they need no block), frequent ones last. Records
are entered under each of those tokens into signature trees: the entries in
order of token, size and bitmap are the leaves, and the nodes above hold ranges
of tokens and sizes and OR-combined token bitmaps. Each tree is traversed
against itself; node pairs that no token spans, whose sizes lie too far apart
or whose largest possible overlap is too small are pruned. This traversal is
the only source of pairs; what it leaves is verified on the whole sets. No pair
is lost: every bound is an upper bound.

Defined results: null, empty and short contents (under least_words words) have
no similarity and no pair; equal contents have similarity 1; rows of equal
identity (repo and id, nulls equal) make no pair; an empty table gives no row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import shingles as S
from tessera.plans.tables import materialize, release, scratch

#: rows of one class that are joined at once
CHUNK = 512


def _ordered(sets: DataFrame, t: float) -> DataFrame:
    """(cid, n, p, toks, wide, c, s*): sets without tokens seen once, in the order of the prefix filter; sets that cannot have a partner are left out."""
    freq = S.frequencies(sets)
    shared = sets.sparkSession.sparkContext.broadcast(freq)

    def run(batches):
        for batch in batches:
            f: S.Frequencies = shared.value
            cids = batch.column(0).to_numpy(zero_copy_only=False)
            col = batch.column(1)
            offsets, flat = col.offsets.to_numpy(), col.values.to_numpy(zero_copy_only=False)
            again, rank = f.repeated(flat), f.ranks(flat)
            out, toks, wide = [], [], []
            for i, cid in enumerate(cids):
                at = slice(offsets[i], offsets[i + 1])
                n = at.stop - at.start
                rest, r = flat[at][again[at]], rank[at][again[at]]
                p = n - int(np.ceil(t * n - 1e-9)) + 1 - (n - len(rest))
                if p <= 0:
                    continue
                sig, c = S.signature(rest)
                out.append((cid, n, min(p, len(rest)), c, *sig.view(np.int64).tolist()))
                toks.append(rest[np.argsort(r, kind="stable")])
                wide.append(S.wide_signature(rest))
            cols = [np.array(x) for x in zip(*out)] or [np.empty(0, np.int64)] * (4 + S.SIG_WORDS)
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32()] + [pa.int64()] * S.SIG_WORDS
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(cols, kinds)] + [S.lists(toks, pa.int64()), S.lists(wide, pa.int64())], names=["cid", "n", "p", "c", *[f"s{i}" for i in range(S.SIG_WORDS)], "toks", "wide"])

    schema = "cid long, n int, p int, c int, " + ", ".join(f"s{i} long" for i in range(S.SIG_WORDS)) + ", toks array<long>, wide array<long>"
    return sets.select("cid", "toks").mapInArrow(run, schema)


def similar_classes(sets: DataFrame, t: float) -> DataFrame:
    """(a, b, sim): all pairs of shingle sets (cid, toks) of similarity t or more."""
    ordered = materialize(_ordered(sets, t), "ordered")
    entries = ordered.select(
        F.explode(F.slice("toks", F.lit(1), F.col("p"))).alias("key"), "cid", "n", "c", F.lit(3).alias("role"), *[f"s{i}" for i in range(S.SIG_WORDS)]
    )
    return S.verified(S.block_pairs(entries, t), ordered, t)


def near_duplicates(df: DataFrame, row_id: str, content: str, t: float = 0.8, k: int = 5, least_words: int = 5) -> tuple[DataFrame, DataFrame]:
    """Members (md5, cid) of the classes long enough to be compared, and links (a, b, sim) between classes."""
    with scratch() as keep:
        sets = materialize(S.shingle_sets(S.content_classes(df, row_id, content, least_words), k, least_words), "sets")
        keep.append(links := materialize(similar_classes(sets, t), "links"))
        keep.append(classes := materialize(sets.select("md5", "cid"), "classes"))
    return classes, links


def row_pairs(df: DataFrame, classes: DataFrame, links: DataFrame, row_id: str, content: str, identity: list[str]) -> DataFrame:
    """(row_a, row_b): the rows of linked classes and of one class whose identities differ.

    A class's rows lie in chunks of some CHUNK; pairs of chunks are what is
    joined, so that a class of many copies is spread over the tasks.
    """
    ident = F.struct(*[F.col(c) for c in identity])
    rows = df.where(F.col(content).isNotNull()).select(F.col(row_id).alias("row"), ident.alias("who"), S.text_key(F.col(content)).alias("md5"))
    rows = rows.join(classes, "md5").select("cid", "row", "who")
    sizes = rows.groupBy("cid").agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("parts"), (F.count(F.lit(1)) > 1).alias("several"))
    part = F.pmod(F.xxhash64("row"), F.col("parts")).cast("int")
    chunks = materialize(rows.join(sizes, "cid").groupBy("cid", part.alias("part")).agg(F.collect_list(F.struct("row", "who")).alias("rows"), F.first("parts").alias("parts"), F.first("several").alias("several")), "chunks")
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    # a class's own rows are pairs too; classes of one row have none
    both = both.unionByName(chunks.where("several and part = 0").select(F.col("cid").alias("a"), F.col("cid").alias("b")))
    parts = chunks.where("part = 0").select(F.col("cid").alias("b"), "parts")
    x = chunks.select(F.col("cid").alias("a"), F.col("rows").alias("ra"))
    y = chunks.select(F.col("cid").alias("b"), F.col("part").alias("of"), F.col("rows").alias("rb"))
    met = both.join(parts, "b").join(x, "a").withColumn("of", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).join(y, ["b", "of"])
    pairs = met.select(F.explode("ra").alias("x"), "rb").select("x", F.explode(F.filter("rb", lambda r: r["row"] > F.col("x.row"))).alias("y"))
    return pairs.where(~F.col("x.who").eqNullSafe(F.col("y.who"))).select(F.col("x.row").alias("row_a"), F.col("y.row").alias("row_b"))


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root): connected components of the links (a, b), by alternating large-star and small-star rounds; each round is a written table."""
    edges = materialize(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    for _ in range(most_rounds):
        # large star: every larger neighbour is tied to the least neighbour or the node itself
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: a node's smaller neighbours and itself are tied to the least of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        done = materialize(small, "edges")
        changed = done.exceptAll(edges).limit(1).count() + edges.exceptAll(done).limit(1).count()
        release(edges)
        edges = done
        if not changed:
            break
    else:
        raise RuntimeError(f"components need more than {most_rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
