"""Positional inverted index as DataFrames, and the counts that ranking needs."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.analysis import index_terms
from tidemark.operators.order import placed
from tidemark.session import materialize

#: Entries of a posting list that one row holds.
BLOCK = 10_000
#: Columns of the flat working form: one row for each term and document.
FLAT = ("term", "doc_id", "tf")


def postings(tokens_: DataFrame, key: str = "doc_id", positions: bool = False) -> DataFrame:
    """(term, key, tf[, tp]): frequency, and rising positions where asked for."""
    aggs = [F.count(F.lit(1)).alias("tf")]
    if positions:
        aggs.append(F.sort_array(F.collect_list("pos")).alias("tp"))
    return tokens_.groupBy("term", key).agg(*aggs)


def term_stats(postings_: DataFrame) -> DataFrame:
    """(term, df, ttf)."""
    return postings_.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").cast("long").alias("ttf"))


def doc_lengths(rows: DataFrame, key: str = "doc_id", text: str = "text", stop: list[str] | None = None) -> DataFrame:
    """(key, dl): tokens that are no stop words; 0 for null and empty texts. Needs no shuffle."""
    terms = index_terms(text)
    if stop:
        words = F.array(*map(F.lit, stop))
        terms = F.filter(terms, lambda t: ~F.array_contains(words, t))
    return rows.select(key, F.coalesce(F.size(terms), F.lit(0)).cast("long").alias("dl")).withColumn("dl", F.greatest("dl", F.lit(0).cast("long")))


def corpus_stats(lengths: DataFrame, terms: DataFrame) -> DataFrame:
    """One row (n_docs, total_len, avgdl, avgdl_int, vocabulary)."""
    of_docs = lengths.agg(F.count(F.lit(1)).alias("n_docs"), F.coalesce(F.sum("dl"), F.lit(0)).cast("long").alias("total_len"), F.avg("dl").alias("avgdl"), F.floor(F.avg("dl")).alias("avgdl_int"))
    return of_docs.crossJoin(F.broadcast(terms.agg(F.count(F.lit(1)).alias("vocabulary"))))  # one row each


def merged(first: DataFrame, second: DataFrame) -> DataFrame:
    """Flat postings of two partial indexes of different documents."""
    return first.unionByName(second)


def nested(postings_: DataFrame, block: int = BLOCK) -> DataFrame:
    """(term, ttf, df, block, postings): lists by falling tf, then document, in blocks of ``block`` entries numbered from 0.

    ``postings_`` has (term, doc_id, tf, tp). A term that a third of all documents hold has many
    blocks, and none of them, nor any task, holds its whole list.
    """
    postings_ = materialize(postings_.select("term", "doc_id", "tf", "tp"))
    stats = term_stats(postings_)
    hot = materialize(stats.filter(F.col("df") > block).select("term"))
    entry = F.struct((-F.col("tf")).alias("o"), "doc_id", "tf", "tp")
    bare = lambda l: F.transform(l, lambda x: F.struct(x["doc_id"].alias("doc_id"), x["tf"].alias("tf"), x["tp"].alias("tp")))
    short = postings_.join(hot, "term", "left_anti").groupBy("term").agg(F.sum("tf").alias("ttf"), F.count(F.lit(1)).alias("df"), F.sort_array(F.collect_list(entry)).alias("l"))  # block entries at most
    lists = short.select("term", F.col("ttf").cast("long").alias("ttf"), "df", F.lit(0).cast("long").alias("block"), bare("l").alias("postings"))
    if hot.isEmpty():
        return lists
    spread = placed(postings_.join(hot, "term", "left_semi"), ["term"], [-F.col("tf"), F.col("doc_id")])
    cut = spread.groupBy("term", F.floor((F.col("place") - 1) / block).cast("long").alias("block")).agg(F.sort_array(F.collect_list(entry)).alias("l"))  # block entries at most
    return lists.unionByName(cut.select("term", "block", bare("l").alias("postings")).join(stats, "term").select(*lists.columns))


def flat(nested_: DataFrame) -> DataFrame:
    """(term, doc_id, tf, tp) of lists in blocks."""
    return nested_.select("term", F.explode("postings").alias("p")).select("term", "p.doc_id", "p.tf", "p.tp")


def merged_lists(parts: list[DataFrame], block: int = BLOCK) -> DataFrame:
    """Lists of partial indexes of different documents as those of one index, sorted anew."""
    return nested(reduce(DataFrame.unionByName, map(flat, parts)), block)


def term_lookup(stats: DataFrame, wanted: DataFrame) -> DataFrame:
    """(term, df, ttf) of each wanted term, 0 where the collection lacks it."""
    zero = F.lit(0).cast("long")
    return wanted.select("term").distinct().join(stats, "term", "left").select("term", F.coalesce("df", zero).alias("df"), F.coalesce("ttf", zero).alias("ttf"))


def counted(rows: DataFrame, key: str = "doc_id", text: str = "text", positions: bool = False) -> DataFrame:
    """(term, key, dl, tf[, tp]), with one row of null term for each document: all an index needs, by one pass over the texts."""
    split = rows.select(key, F.coalesce(index_terms(text), F.array().cast("array<string>")).alias("_terms"))
    found = split.select(key, F.size("_terms").cast("long").alias("dl"), F.posexplode(F.array_append("_terms", F.lit(None).cast("string"))).alias("pos", "term"))
    aggs = [F.max("dl").alias("dl"), F.count(F.lit(1)).alias("tf")]
    if positions:
        aggs.append(F.sort_array(F.collect_list(F.col("pos") + 1)).alias("tp"))
    return found.groupBy("term", key).agg(*aggs)


@dataclass
class Index:
    """The tables of an index; ``docs`` keeps documents without tokens, and ``postings`` holds the lengths of its documents."""

    postings: DataFrame
    terms: DataFrame
    docs: DataFrame

    @staticmethod
    def build(rows: DataFrame, key: str = "doc_id", text: str = "text", positions: bool = False) -> Index:
        """Written once to the shared folder; every use reads the postings, and no text again."""
        table = materialize(counted(rows, key, text, positions))
        found = table.filter("term is not null")
        return Index(found, term_stats(found), table.filter("term is null").select(key, "dl"))

    def stats(self) -> DataFrame:
        return corpus_stats(self.docs, self.postings.select("term").distinct())

    def of_terms(self, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(postings, term statistics) of the terms in ``wanted`` (term) only: what a query needs is cut out before any join."""
        found = self.postings.join(wanted.select("term").distinct(), "term", "left_semi")
        return found, term_stats(found)

    def save(self, folder: str, buckets: int = 64) -> None:
        """Parquet tables; postings are sorted by term within ranges of it, so that a term's lookup reads few row groups."""
        self.postings.repartitionByRange(buckets, "term").sortWithinPartitions("term", F.desc("tf")).write.mode("overwrite").parquet(f"{folder}/postings")
        self.terms.write.mode("overwrite").parquet(f"{folder}/terms")
        self.docs.write.mode("overwrite").parquet(f"{folder}/docs")

    @staticmethod
    def load(spark: SparkSession, folder: str) -> Index:
        return Index(*(spark.read.parquet(f"{folder}/{x}") for x in ("postings", "terms", "docs")))
