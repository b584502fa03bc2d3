"""Places within groups of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.session import materialize


def placed(rows: DataFrame, group: Sequence[str], order: Sequence[Column], name: str = "place") -> DataFrame:
    """``rows`` with ``name``, the place from 1 of each row in its group by ``order``, which must be total.

    A group may hold any share of the rows: they are sorted over range partitions and counted on
    by the partitions' sizes, so that no task sorts a whole group. Nulls group together.
    """
    keys = [f"_o{i}" for i in range(len(order))]
    keyed = rows.withColumns(dict(zip(keys, order)))
    parts = max(2, rows.sparkSession.sparkContext.defaultParallelism)
    spread = materialize(keyed.repartitionByRange(parts, *group, *keys).withColumn("_part", F.spark_partition_id()))
    upto = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = spread.groupBy(*group, "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select(*(F.col(g).alias(f"_g{i}") for i, g in enumerate(group)), F.col("_part").alias("_p"), F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy(*group, "_part").orderBy(*keys))
    met = F.col("_part") == F.col("_p")
    for i, g in enumerate(group):
        met = met & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    out = spread.withColumn(name, place).join(before, met).withColumn(name, F.col(name) + F.col("_before"))
    return out.select(*rows.columns, F.col(name).cast("long").alias(name))
