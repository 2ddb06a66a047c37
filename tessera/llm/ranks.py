"""Problem 4: one ranking from several differently scaled scores, by median rank aggregation.

Every item is ranked in each score by itself; items are ordered by the weighted
median of their ranks, then by their mean, then by identifier. Only the order
within a score counts, so no score outweighs another by its range.

A group may hold a third of all rows: equal values are counted together before
the shuffle, and a rank is the number of greater values in greater buckets plus
those in its own bucket, so that no window has to sort a whole group.

Defined results: only finite values above zero are ranked; null, missing,
negative and not finite ones are not; an item's repeated rows count once, with
its greatest value; an item without a score has the rank after the last in it;
an item without any score comes last, with score null; ties share the smaller
rank; null group or item keys are keys of their own; empty tables give no row.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: buckets of values for each power of e
BUCKETS = 256
#: median ranks that are a bucket of their own; those beyond share some, the more the greater they are
PLACES = 4096


def part(parts: Column, *names: str) -> Column:
    """The greatest finite value above zero under the first of the names, in any letter case, that the map holds with a value."""

    def values(name: str) -> Column:
        entries = F.filter(F.map_entries(parts), lambda e: (F.lower(F.trim(e["key"])) == name) & e["value"].isNotNull())
        return F.transform(entries, lambda e: e["value"])

    found = values(names[-1])
    for name in reversed(names[:-1]):
        found = F.when(F.size(values(name)) > 0, values(name)).otherwise(found)
    return F.array_max(F.filter(found, lambda v: (v > 0) & ~F.isnan(v) & (v < float("inf"))))


def item_values(df: DataFrame, group: list[str], item: list[str], scores: Mapping[str, Column]) -> DataFrame:
    """(group, item, score columns): each item once, with its greatest value in each score."""
    return df.select(*group, *item, *[c.alias(s) for s, c in scores.items()]).groupBy(*group, *item).agg(*[F.max(s).alias(s) for s in scores])


def score_ranks(items: DataFrame, group: list[str], item: list[str], scores: list[str]) -> DataFrame:
    """(group, item, part, value, rank, ranked): rank from 1 by falling value among the group's items that have the score."""
    long = items.select(*group, *item, F.explode(F.array(*[F.struct(F.lit(s).alias("part"), F.col(s).alias("value")) for s in scores])).alias("p")).select(*group, *item, "p.part", "p.value").where("value is not null")
    keys = [*group, "part"]
    long = long.withColumn("bucket", F.floor(F.log("value") * BUCKETS))
    values = long.groupBy(*keys, "bucket", "value").agg(F.count(F.lit(1)).alias("n"))
    above = Window.partitionBy(*keys).orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, -1)
    buckets = values.groupBy(*keys, "bucket").agg(F.sum("n").alias("n"))
    buckets = buckets.select(*keys, "bucket", F.coalesce(F.sum("n").over(above), F.lit(0)).alias("above"), F.sum("n").over(Window.partitionBy(*keys)).alias("ranked"))
    within = Window.partitionBy(*keys, "bucket").orderBy(F.desc("value")).rowsBetween(Window.unboundedPreceding, -1)
    values = values.select(*keys, "bucket", "value", F.coalesce(F.sum("n").over(within), F.lit(0)).alias("beside"))
    same = lambda a, b, names: [a[c].eqNullSafe(b[c]) for c in names]
    ranked = values.alias("v").join(buckets.alias("b"), [F.col(f"v.{c}").eqNullSafe(F.col(f"b.{c}")) for c in [*keys, "bucket"]]).select(
        *[F.col(f"v.{c}").alias(c) for c in keys], "value", (F.col("above") + F.col("beside") + 1).alias("rank"), "ranked"
    )
    return long.alias("l").join(ranked.alias("r"), [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in [*keys, "value"]]).select(
        *[F.col(f"l.{c}") for c in [*group, *item, "part", "value"]], "rank", "ranked"
    )


def median_rank(items: DataFrame, group: list[str], item: list[str], weights: Mapping[str, float]) -> DataFrame:
    """(group, item, ranks, median_rank, mean_rank, score, parts): ranks holds the item's rank in each score that it has; score is 1 / median_rank.

    The weighted median is the least rank at which half the weight is reached.
    placed() gives the order that follows from median, mean and item.
    """
    scores = list(weights)
    ranks = score_ranks(items, group, item, scores)
    last = ranks.groupBy(*group, "part").agg(F.max("ranked").alias("ranked")).groupBy(*group).agg(F.map_from_entries(F.collect_list(F.struct("part", "ranked"))).alias("last"))
    own = ranks.groupBy(*group, *item).agg(F.map_from_entries(F.collect_list(F.struct("part", "rank"))).alias("own"))
    keys = [*group, *item]
    df = items.select(*keys).alias("i").join(own.alias("o"), [F.col(f"i.{c}").eqNullSafe(F.col(f"o.{c}")) for c in keys], "left").select(*[F.col(f"i.{c}") for c in keys], "own")
    df = df.alias("i").join(last.alias("l"), [F.col(f"i.{c}").eqNullSafe(F.col(f"l.{c}")) for c in group], "left").select(*[F.col(f"i.{c}") for c in keys], "own", "last")
    pairs = F.array_sort(
        F.array(*[F.struct(F.coalesce(F.col("own")[s], F.col("last")[s] + 1, F.lit(1)).cast("double").alias("r"), F.lit(float(w)).alias("w")) for s, w in weights.items()])
    )
    half = sum(weights.values()) / 2
    median = F.aggregate(
        pairs,
        F.struct(F.lit(0.0).alias("w"), F.lit(None).cast("double").alias("r")),
        lambda a, x: F.struct((a["w"] + x["w"]).alias("w"), F.coalesce(a["r"], F.when(a["w"] + x["w"] >= half, x["r"])).alias("r")),
    )["r"]
    mean = F.aggregate(pairs, F.lit(0.0), lambda a, x: a + x["r"]) / len(weights)
    parts = F.coalesce(F.size(F.map_keys("own")), F.lit(0))
    return df.select(*keys, F.col("own").alias("ranks"), median.alias("median_rank"), mean.alias("mean_rank"), parts.alias("parts")).withColumn("score", F.when(F.col("parts") > 0, 1 / F.col("median_rank")))


def placed(ranking: DataFrame, group: list[str], item: list[str]) -> DataFrame:
    """The ranking with place, from 1: by median rank, mean rank and item; items without a score come last.

    A group is ordered in buckets of medians, each with the number of items in
    the buckets before it, so that no window has to sort all of a group's scored
    items; those without a score are one bucket, sorted with spilling.
    """
    bucket = F.when(F.col("parts") == 0, F.lit(1 << 30)).otherwise(F.floor(F.when(F.col("median_rank") < PLACES, F.col("median_rank")).otherwise(PLACES * (1 + F.log(F.col("median_rank") / PLACES)))).cast("int"))
    rows = ranking.withColumn("bucket", bucket)
    before = Window.partitionBy(*group).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy(*group, "bucket").agg(F.count(F.lit(1)).alias("n")).select(*group, "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    within = Window.partitionBy(*group, "bucket").orderBy("median_rank", "mean_rank", *[F.col(c).asc_nulls_first() for c in item])
    rows = rows.withColumn("within", F.row_number().over(within))
    met = rows.alias("r").join(sizes.alias("s"), [F.col(f"r.{c}").eqNullSafe(F.col(f"s.{c}")) for c in [*group, "bucket"]])
    return met.select(*[F.col(f"r.{c}") for c in ranking.columns], (F.col("before") + F.col("within")).alias("place"))
