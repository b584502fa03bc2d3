"""Connected components: union-find forests per partition, merged level by level."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import drop_materialized, materialize, ship_package

#: A forest of at most this many edges may be merged in one task (two longs an edge).
MERGE_ROWS = 1_000_000
FAN_IN = 8


def _forest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Union-find over one partition's edges; gives (vertex, smallest vertex of its local tree)."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while (up := parent.setdefault(top, top)) != top:
            top = up
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    for batch in batches:
        for a, b in zip(batch["a"].tolist(), batch["b"].tolist()):
            x, y = root(a), root(b)
            if x < y:
                parent[y] = x
            elif y < x:
                parent[x] = y
    rows = [(v, r) for v in list(parent) if (r := root(v)) != v]
    for at in range(0, len(rows), 100_000):
        yield pd.DataFrame(rows[at : at + 100_000], columns=["a", "b"], dtype="int64")


def _forests(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").mapInPandas(_forest, "a long, b long")


def _star_round(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step, the way for forests too large for one task."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b").distinct()
    down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    joined = down.join(least, "a")
    small = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return small.filter("a != b").distinct()


def _print(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(2**31)))).first()
    return row[0], row[1] or 0


def components(edges: DataFrame, merge_rows: int = MERGE_ROWS, fan_in: int = FAN_IN) -> DataFrame:
    """The component of each vertex of ``edges`` (a long, b long).

    Returns ``(vertex long, component long)``, a row for each vertex that is not the smallest
    of its component; ``component`` is that smallest vertex. Null ends and loops tie nothing;
    repeated edges count once; no edges give no rows. Each partition reduces its edges to a
    union-find forest; forests are merged ``fan_in`` at a time until one task can hold all of
    them (``merge_rows`` edges at most). A forest that stays larger is finished by rounds of
    large-star and small-star, which hold no more than a partition anywhere.
    """
    ship_package(edges.sparkSession)
    edges = edges.select("a", "b").filter("a is not null and b is not null and a != b")
    now = materialize(_forests(edges))
    n, parts = now.count(), max(1, now.rdd.getNumPartitions())
    while parts > 1 or n > merge_rows:
        fewer = 1 if n <= merge_rows else max(-(-parts // fan_in), -(-n // merge_rows))
        if fewer >= parts:
            seen = None
            while (key := _print(now)) != seen:
                seen, old = key, now
                now = materialize(_star_round(old))
                drop_materialized(old)
            break
        old = now
        now = materialize(_forests(old.repartition(fewer, F.spark_partition_id() % fewer)))
        drop_materialized(old)
        n, parts = now.count(), fewer
    return now.select(F.col("a").alias("vertex"), F.col("b").alias("component"))
