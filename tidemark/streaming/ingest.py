"""Continuous ingestion: postings of new documents, distinct urls, latest assessments, windowed counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from tidemark.operators import index as ix
from tidemark.operators.analysis import tokens


def index_stream(documents: DataFrame, folder: str, checkpoint: str, key: str = "doc_id", text: str = "text") -> DataStreamWriter:
    """Appends the postings and lengths of each micro-batch; a batch delivered again replaces itself, its number being a partition."""

    def append(batch: DataFrame, number: int) -> None:
        rows = batch.dropDuplicates([key])
        for name, made in (("postings", ix.postings(tokens(rows, key, text), key)), ("docs", ix.doc_lengths(rows, key, text))):
            made.write.mode("overwrite").parquet(f"{folder}/{name}/batch={number}")

    return documents.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint)


def frontier_stream(links: DataFrame, url: str = "url", at: str = "ts", delay: str = "1 day") -> DataFrame:
    """Links not met before within the watermark: the visited set of a crawl as state."""
    return links.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, delay).dropDuplicatesWithinWatermark([url])


def windowed_counts(events: DataFrame, at: str = "ts", kind: str = "event_type", value: str = "value", size: str = "1 hour", slide: str | None = None, delay: str = "10 minutes") -> DataFrame:
    """(start, end, kind, n, mean) of event-time windows; rows later than the watermark are dropped in a stream."""
    window = F.window(at, size, slide) if slide else F.window(at, size)
    out = events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, delay).groupBy(window.alias("w"), kind).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), kind, "n", "mean")


def upsert_stream(rows: DataFrame, path: str, checkpoint: str, keys: list[str], order: str) -> DataStreamWriter:
    """Keeps the latest row of each key in two alternating tables; readers take the one ``current`` names."""

    def merge(batch: DataFrame, number: int) -> None:
        from tidemark.operators.web import latest

        spark = batch.sparkSession
        old, new = f"{path}/{(number + 1) % 2}", f"{path}/{number % 2}"
        both = batch
        if number:
            both = spark.read.schema(batch.schema).parquet(old).unionByName(batch)
        latest(both, keys, order).select(*batch.columns).write.mode("overwrite").parquet(new)

    return rows.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
