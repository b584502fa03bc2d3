"""Problem 4: one ranking from several differently-scaled scores, by Borda count."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.session import materialize

#: A group of more rows is ranked over range partitions instead of in one task.
GROUP_ROWS = 50_000


def known(score: str) -> Column:
    """The score, null where it is null, NaN or infinite."""
    x = F.col(score).cast("double")
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def _within(items: DataFrame, group: str, scores: Sequence[str], weights: Sequence[float]) -> DataFrame:
    """Points of the items of groups that one task can hold: one shuffle by group, a sort per score."""
    size = F.count(F.lit(1)).over(Window.partitionBy(group))
    out = items.withColumn("n_items", size)
    points = F.lit(0.0)
    for score, weight in zip(scores, weights):
        upto = F.count(score).over(Window.partitionBy(group).orderBy(F.desc_nulls_last(score)).rangeBetween(Window.unboundedPreceding, Window.currentRow))
        place = F.rank().over(Window.partitionBy(group).orderBy(F.desc_nulls_last(score)))
        out = out.withColumn(f"_rank_{score}", F.when(F.col(score).isNull(), (F.col("n_items") + 1) / 2).otherwise((place + upto) / 2))
        points = points + weight * (F.col("n_items") - F.col(f"_rank_{score}"))
    return out.withColumn("points", points).drop(*(f"_rank_{s}" for s in scores))


def _across(items: DataFrame, sizes: DataFrame, group: str, item: str, scores: Sequence[str], weights: Sequence[float]) -> DataFrame:
    """The same points for groups of any size: values are counted over range partitions."""
    n = len(scores)
    long = items.select(group, item, F.posexplode(F.array(*scores)).alias("s", "v"))
    values = long.filter("v is not null").groupBy(group, "s", "v").agg(F.count(F.lit(1)).alias("c"))
    parts = max(2, items.sparkSession.sparkContext.defaultParallelism)
    spread = materialize(values.repartitionByRange(parts, group, "s", F.desc("v")).withColumn("part", F.spark_partition_id()))
    totals = spread.groupBy(group, "s", "part").agg(F.sum("c").alias("t"))
    before = totals.withColumn("before", F.coalesce(F.sum("t").over(Window.partitionBy(group, "s").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("t")
    upto = F.sum("c").over(Window.partitionBy(group, "s", "part").orderBy(F.desc("v")))
    ranks = spread.withColumn("upto", upto).join(before, [group, "s", "part"]).select(group, "s", "v", (F.col("before") + F.col("upto") - (F.col("c") - 1) / 2).alias("r"))
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), F.col("s") + 1)
    found = long.filter("v is not null").join(ranks, [group, "s", "v"]).groupBy(group, item).agg(F.sum(weight * F.col("r")).alias("known_ranks"), F.sum(weight).alias("known_weight"))
    out = items.join(found, [group, item], "left").join(sizes, group)
    zero = F.lit(0.0)
    missing = F.lit(float(sum(weights))) - F.coalesce("known_weight", zero)
    ranks = F.coalesce("known_ranks", zero) + missing * (F.col("n_items") + 1) / 2
    return out.withColumn("points", F.lit(float(sum(weights))) * F.col("n_items") - ranks).drop("known_ranks", "known_weight").select(*items.columns, "n_items", "points") if n else items


def borda_points(rows: DataFrame, group: str, item: Column, scores: Sequence[str], weights: Sequence[float] | None = None, group_rows: int = GROUP_ROWS) -> DataFrame:
    """(group, item, scores..., n_items, points): the Borda count of each item of each group.

    Each score ranks the items of a group from its highest value, equal values sharing the mean
    of their ranks; a score that is null, NaN or infinite gives the middle rank (n + 1) / 2.
    Points are the weighted sum of n - rank. Rows of one item count once: equal rows are one,
    of different ones each score's best known value holds. Null groups and items are left out;
    an empty table gives no rows; other columns of ``rows`` are not looked at.

    Groups up to ``group_rows`` rows are ranked in one task each; larger ones over range
    partitions, so that no group need fit into a task.
    """
    weights = list(weights or [1.0] * len(scores))
    clean = rows.select(F.col(group), item.alias("item"), *(known(s).alias(s) for s in scores)).filter(F.col(group).isNotNull() & F.col("item").isNotNull())
    counts = clean.groupBy(group).agg(F.count(F.lit(1)).alias("_rows"))
    large = materialize(counts.filter(F.col("_rows") > group_rows).select(group))
    per_item = [F.max(s).alias(s) for s in scores]
    if large.isEmpty():
        return _within(clean.repartition(group).groupBy(group, "item").agg(*per_item), group, scores, weights)
    small = clean.join(large, group, "left_anti").repartition(group).groupBy(group, "item").agg(*per_item)
    big = materialize(clean.join(large, group, "left_semi").groupBy(group, "item").agg(*per_item))
    sizes = big.groupBy(group).agg(F.count(F.lit(1)).alias("n_items"))
    return _within(small, group, scores, weights).unionByName(_across(big, sizes, group, "item", scores, weights))


def first_of_each(points: DataFrame, group: str, least_items: int = 1) -> DataFrame:
    """(group, item): the first item in points, ties by the smaller item; needs no sort of a group."""
    best = F.min_by("item", F.struct(-F.round("points", 9), F.col("item")))
    return points.filter(F.col("n_items") >= least_items).groupBy(group).agg(best.alias("item"))


def borda_ranking(points: DataFrame, group: str, group_rows: int = GROUP_ROWS) -> DataFrame:
    """``points`` with ``place`` from 1 in each group: points downwards, then the item.

    Ordered over range partitions with counts before each, so that groups of any size work.
    """
    keyed = points.withColumn("_key", -F.round("points", 9))
    parts = max(2, points.sparkSession.sparkContext.defaultParallelism)
    spread = materialize(keyed.repartitionByRange(parts, group, "_key", "item").withColumn("_part", F.spark_partition_id()))
    before = spread.groupBy(group, "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = before.withColumn("_before", F.coalesce(F.sum("_n").over(Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    place = F.row_number().over(Window.partitionBy(group, "_part").orderBy("_key", "item"))
    return spread.withColumn("place", place).join(before, [group, "_part"]).withColumn("place", F.col("place") + F.col("_before")).drop("_before", "_part", "_key")
