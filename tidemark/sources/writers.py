"""Writers: indexes, runs, features, and keyed updates of stored tables."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def load(rows: DataFrame, path: str, key: str | None = None, order: str | None = None, partition_by: Iterable[str] = ()) -> None:
    """Replace the table at ``path`` by ``rows``; with ``key`` the last delivery (by ``order``) of each key holds."""
    if key:
        from tidemark.operators.web import latest

        rows = latest(rows, [key], order) if order else rows.dropDuplicates([key])
    rows.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def updated(stored: DataFrame, changes: DataFrame, key: str, insert: bool = True) -> DataFrame:
    """``stored`` with the columns of ``changes`` that are not null put over its own; new columns are added.

    Keys of ``changes`` are unique. With ``insert`` unknown keys are added, else left out.
    """
    new = changes.select(key, *(F.col(c).alias(f"_new_{c}") for c in changes.columns if c != key))
    joined = stored.join(new, key, "full_outer" if insert else "left")
    columns = [*stored.columns, *(c for c in changes.columns if c not in stored.columns)]
    pick = lambda c: F.col(c) if c == key or c not in changes.columns else (F.coalesce(f"_new_{c}", c) if c in stored.columns else F.col(f"_new_{c}"))
    return joined.select(*(pick(c).alias(c) for c in columns))


def without(stored: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """``stored`` without the rows whose key is in ``ids``."""
    return stored.join(ids.select(key).distinct(), key, "left_anti")


def with_fields(rows: DataFrame, **defaults: object) -> DataFrame:
    """``rows`` with new columns of the given values where they lack them."""
    return rows.withColumns({c: F.lit(v) for c, v in defaults.items() if c not in rows.columns})


def write_run(run: DataFrame, path: str, tag: str = "Exp", depth: int = 1000) -> None:
    """``query Q0 document rank score tag`` lines, the first ``depth`` of each query, ordered within partitions by query and rank."""
    kept = run.filter(F.col("rank") <= depth).repartitionByRange("query_id").sortWithinPartitions("query_id", "rank")
    line = F.concat_ws(" ", F.col("query_id").cast("string"), F.lit("Q0"), "doc_id", F.col("rank").cast("string"), F.col("score").cast("string"), F.lit(tag))
    kept.select(line.alias("value")).write.mode("overwrite").text(path)


def list_as_run(ranked: DataFrame, top: int = 201) -> DataFrame:
    """A list (query_id, doc_id, pos) as a run with the scores ``top`` - rank."""
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("pos")).cast("long")
    return ranked.withColumn("rank", rank).select("query_id", "doc_id", "rank", (F.lit(top) - F.col("rank")).cast("double").alias("score"))


def write_features(rows: DataFrame, path: str) -> None:
    """CSV with a header, a folder for each split if there is a ``part`` column."""
    writer = rows.write.mode("overwrite").option("header", "true")
    (writer.partitionBy("part") if "part" in rows.columns else writer).csv(path)


def write_truth(rows: DataFrame, path: str) -> None:
    """``query document label`` lines of judged rows."""
    kept = rows.filter("label is not null")
    kept.select(F.concat_ws(" ", F.col("query_id").cast("string"), "doc_id", F.col("label").cast("string")).alias("value")).write.mode("overwrite").text(path)


def write_adjacency(lists: DataFrame, path: str) -> None:
    """``node neighbour neighbour ...`` lines of (id, links)."""
    lists.select(F.concat_ws(" ", F.col("id").cast("string"), F.array_join(F.col("links").cast("array<string>"), " ")).alias("value")).write.mode("overwrite").text(path)


def write_lines(rows: DataFrame, path: str) -> None:
    """One column of strings as lines."""
    rows.select(F.col(rows.columns[0]).cast("string").alias("value")).write.mode("overwrite").text(path)


def save_model(model, path: str) -> None:
    """A fitted model or pipeline, in place of an earlier one."""
    model.write().overwrite().save(path)


def store_clusters(clustered: DataFrame, path: str, cluster: str = "cluster") -> None:
    """Cluster labels as a table with a folder for each cluster, so that a cluster's members are read without the others."""
    clustered.write.mode("overwrite").partitionBy(cluster).parquet(path)
