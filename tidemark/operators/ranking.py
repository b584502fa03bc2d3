"""Lexical ranking models over flat postings."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators.blocks import Model, Parts, Stats, first_ranks
from tidemark.operators.index import Index
from tidemark.session import materialize

# Fixed values of the models.
K1, B = 1.2, 0.75
LAMBDA, LAMBDA_CONSTANT = 0.3, 0.5
DEPTH = 1000


def okapi(tf: str | Column = "tf", dl: str | Column = "dl", avgdl: str | Column = "avgdl") -> Column:
    tf, dl, avgdl = (F.col(x) if isinstance(x, str) else x for x in (tf, dl, avgdl))
    return tf / (tf + 0.5 + 1.5 * dl / avgdl)


def bm25(n: str | Column = "n_docs") -> Column:
    n = F.col(n) if isinstance(n, str) else n
    weight = (K1 + 1) * F.col("tf") / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return weight * F.log((n + 0.5) / (F.col("df") + 0.5))


def parts_of(df: DataFrame) -> int:
    return max(df.sparkSession.sparkContext.defaultParallelism, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


#: Stands for a term that each query has and the ``spare`` documents hold.
_SPARE = ""


def matches(index: Index, queries: DataFrame, spare: DataFrame | None = None, per_query: DataFrame | None = None) -> DataFrame:
    """Query terms met with their postings, document lengths and the collection's counts.

    ``queries``: (query_id, term, qtf). Terms the collection lacks are dropped; each summand counts
    qtf times. Only the postings of query terms are counted and joined, and they bring their
    documents' lengths along; the statistics are one row. The few postings are dealt out by
    document, so that scores of (query, document) pairs, many times as many, need no shuffle
    where the queries are small enough to be broadcast.

    With ``spare`` (doc_id, dl) each query meets these documents too, with the empty term and qtf 0;
    ``per_query`` (query_id, ...) adds its columns. The query side is written once, so that the
    planner knows its size when it chooses the join.
    """
    found, terms = index.of_terms(queries)
    found = found.select("term", "doc_id", "dl", "tf")
    if spare is not None:
        found = found.unionByName(spare.select(F.lit(_SPARE).alias("term"), "doc_id", "dl", F.lit(0).cast("long").alias("tf")))
        queries = queries.select("query_id", "term", "qtf").unionByName(queries.select("query_id", F.lit(_SPARE).alias("term"), F.lit(0).cast("long").alias("qtf")).distinct())
        terms = terms.unionByName(terms.sparkSession.createDataFrame([(_SPARE, 0, 0)], terms.schema))
    found = found.repartition(parts_of(found), "doc_id")
    asked = queries.join(terms, "term")
    if per_query is not None:
        asked = asked.join(per_query, "query_id")
    return found.join(materialize(asked), "term").crossJoin(F.broadcast(index.stats()))  # one row


def _six_places(x: Column) -> Column:
    """Half away from zero, as round() does by way of decimals, which is slow."""
    return F.signum(x) * F.floor(F.abs(x) * 1e6 + 0.5) / 1e6


def top(scores: DataFrame, depth: int = DEPTH, descending_ids: bool = False) -> DataFrame:
    """(query_id, doc_id, rank, score): the first ``depth`` of each query by rounded score, then id.

    The rank filter is pushed into the window, so each task keeps ``depth`` rows of a query.
    """
    order = F.desc("doc_id") if descending_ids else F.col("doc_id")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), order))
    rounded = scores.select("query_id", "doc_id", _six_places(F.col("score")).alias("score"))
    return rounded.withColumn("rank", place).filter(F.col("rank") <= depth).select("query_id", "doc_id", F.col("rank").cast("long").alias("rank"), "score")


def _summed(index: Index, queries: DataFrame, summand: Column, spare: DataFrame | None = None, per_query: DataFrame | None = None) -> DataFrame:
    summand = F.col("qtf") * summand
    if spare is not None:
        summand = F.when(F.col("term") == _SPARE, 0.0).otherwise(summand)
    kept = ["dl", *(c for c in (per_query.columns if per_query is not None else ()) if c != "query_id")]
    return matches(index, queries, spare, per_query).groupBy("query_id", "doc_id").agg(F.sum(summand).alias("score"), *(F.max(c).alias(c) for c in kept))


def okapi_tf(index: Index, queries: DataFrame) -> DataFrame:
    return _summed(index, queries, okapi())


def tf_idf(index: Index, queries: DataFrame, log2: bool = False) -> DataFrame:
    ratio = F.col("n_docs") / F.col("df")
    return _summed(index, queries, okapi() * (F.log2(ratio) if log2 else F.log(ratio)))


def bm25_scores(index: Index, queries: DataFrame) -> DataFrame:
    return _summed(index, queries, bm25())


def _query_sizes(queries: DataFrame) -> DataFrame:
    return queries.groupBy("query_id").agg(F.sum("qtf").alias("q_len"))


def _shortest(index: Index, depth: int) -> DataFrame:
    return index.docs.orderBy("dl", "doc_id").limit(depth)


def _first(index: Index, depth: int) -> DataFrame:
    return index.docs.orderBy("doc_id").limit(depth)


def laplace(index: Index, queries: DataFrame, depth: int = DEPTH, log2: bool = False) -> DataFrame:
    """Scores of every document that can be among the first ``depth`` of a query.

    score = sum over matches of log(tf + 1) - |Q| log(dl + V). A document without a match scores
    by its length alone, so only the ``depth`` shortest of them can count: their number is
    ``depth`` whatever the collection's size.
    """
    log = F.log2 if log2 else F.log
    gain = _summed(index, queries, log(F.col("tf") + 1), _shortest(index, depth), _query_sizes(queries))
    full = gain.crossJoin(F.broadcast(index.stats()))  # one row
    return full.select("query_id", "doc_id", (F.col("score") - F.col("q_len") * log(F.col("dl") + F.col("vocabulary"))).alias("score"))


def jelinek_mercer(index: Index, queries: DataFrame, depth: int = DEPTH, lam: float = LAMBDA) -> DataFrame:
    """sum over known query terms of ln(lam tf / dl + (1 - lam) ttf / C), as a base for each query and a gain for each match.

    Documents without a match all have the base, so the ``depth`` first ids stand for them.
    """
    background = (1 - lam) * F.col("ttf") / F.col("total_len")
    known = queries.join(index.of_terms(queries)[1], "term").crossJoin(F.broadcast(index.stats()))  # one row
    base = known.groupBy("query_id").agg(F.sum(F.col("qtf") * F.log(background)).alias("base"))
    summand = F.log(lam * F.col("tf") / F.col("dl") + background) - F.log(background)
    return _on_base(_summed(index, queries, summand, _first(index, depth), base))


def jelinek_mercer_constant(index: Index, queries: DataFrame, depth: int = DEPTH, lam: float = LAMBDA_CONSTANT) -> DataFrame:
    """sum over all query terms of log2((1 - lam) C / V + lam tf / dl): the background is one constant."""
    background = (1 - lam) * F.col("total_len") / F.col("vocabulary")
    base = _query_sizes(queries).crossJoin(F.broadcast(index.stats())).select("query_id", (F.col("q_len") * F.log2(background)).alias("base"))  # one row
    summand = F.log2(background + lam * F.col("tf") / F.col("dl")) - F.log2(background)
    return _on_base(_summed(index, queries, summand, _first(index, depth), base))


def _on_base(gains: DataFrame) -> DataFrame:
    return gains.select("query_id", "doc_id", (F.col("score") + F.col("base")).alias("score"))


def _okapi(tf: np.ndarray, dl: np.ndarray, stats: Stats) -> np.ndarray:
    return tf / (tf + 0.5 + 1.5 * dl / stats.avgdl)


def _bm25(tf: np.ndarray, dl: np.ndarray, df: int, ttf: int, stats: Stats) -> np.ndarray:
    return (K1 + 1) * tf / (tf + K1 * (1 - B + B * dl / stats.avgdl)) * np.log((stats.n_docs + 0.5) / (df + 0.5))


def _laplace(log) -> Model:
    return Model(lambda tf, dl, df, ttf, stats: log(tf + 1.0), by_length=lambda dl, stats: log(dl + float(stats.vocabulary)))


def _jelinek_mercer(lam: float = LAMBDA) -> Model:
    def base(qtf: np.ndarray, df: np.ndarray, ttf: np.ndarray, stats: Stats) -> float | None:
        known = df > 0
        return float(np.sum(qtf[known] * np.log((1 - lam) * ttf[known] / stats.total_len))) if known.any() else None

    def gain(tf: np.ndarray, dl: np.ndarray, df: int, ttf: int, stats: Stats) -> np.ndarray:
        background = (1 - lam) * ttf / stats.total_len
        return np.log(lam * tf / dl + background) - np.log(background)

    return Model(gain, base)


def _jelinek_mercer_constant(lam: float = LAMBDA_CONSTANT) -> Model:
    background = lambda stats: (1 - lam) * stats.total_len / stats.vocabulary
    return Model(lambda tf, dl, df, ttf, stats: np.log2(background(stats) + lam * tf / dl) - np.log2(background(stats)), lambda qtf, df, ttf, stats: float(np.sum(qtf)) * float(np.log2(background(stats))))


#: The models over an index in parts; their formulas are those of the functions above.
MODELS = {
    "okapi_tf": Model(lambda tf, dl, df, ttf, stats: _okapi(tf, dl, stats)),
    "tf_idf": Model(lambda tf, dl, df, ttf, stats: _okapi(tf, dl, stats) * np.log(stats.n_docs / df)),
    "tf_idf_log2": Model(lambda tf, dl, df, ttf, stats: _okapi(tf, dl, stats) * np.log2(stats.n_docs / df)),
    "bm25": Model(_bm25),
    "laplace": _laplace(np.log),
    "laplace_log2": _laplace(np.log2),
    "jelinek_mercer": _jelinek_mercer(),
    "jm_constant_bg": _jelinek_mercer_constant(),
}


def run_of(parts: Parts, queries: DataFrame, model: str, depth: int = DEPTH, descending_ids: bool = False) -> DataFrame:
    """As :func:`top` of the model's scores, for many queries: no pair of a query and a document becomes a row but the first ``depth``."""
    return first_ranks(parts, queries, MODELS[model], depth, descending_ids)


def category_scores(index: Index, categories: DataFrame) -> DataFrame:
    """(doc_id, score): BM25 with a category as one term: its frequencies summed, its df the largest of its terms."""
    found, terms = index.of_terms(categories)
    per_doc = found.join(F.broadcast(categories), "term").groupBy("category", "doc_id").agg(F.sum("tf").alias("tf"), F.max("dl").alias("dl"))  # a list given by the caller
    df = categories.join(terms, "term").groupBy("category").agg(F.max("df").alias("df"))
    full = per_doc.join(F.broadcast(df), "category").crossJoin(F.broadcast(index.stats()))  # a row each category; one row
    return full.groupBy("doc_id").agg(F.sum(bm25()).alias("score"))


def topic_scores(postings_: DataFrame, lengths: DataFrame, categories: DataFrame, avgdl: float = 500.0) -> DataFrame:
    """(doc_id, score): Okapi TF of each category's summed frequency against a running mean length."""
    found = postings_.join(F.broadcast(categories), "term").groupBy("category", "doc_id").agg(F.sum("tf").alias("tf"))  # a list given by the caller
    return found.join(lengths, "doc_id").groupBy("doc_id").agg(F.sum(okapi(avgdl=F.lit(avgdl))).alias("score"))


def crawl_priority(scores: DataFrame, parent: str = "parent_score") -> DataFrame:
    """``page_score`` = 0.8 topic score + the parent's score; ``child_score`` = 0.2 of it."""
    page = 0.8 * F.col("score") + F.coalesce(F.col(parent), F.lit(0.0))
    return scores.withColumn("page_score", page).withColumn("child_score", 0.2 * page)


def phrase_freq(tokens_: DataFrame, phrases: DataFrame, key: str = "doc_id") -> DataFrame:
    """(phrase_id, key, freq) of ordered adjacent terms. ``phrases``: (phrase_id, words array).

    Tokens of the phrases' words meet at the place where the phrase would begin; a place with all
    of the phrase's words is an occurrence. One shuffle, however long the phrases are.
    """
    parts = phrases.select("phrase_id", F.size("words").alias("len"), F.posexplode("words").alias("k", "term"))
    begun = tokens_.join(F.broadcast(parts), "term").withColumn("begin", F.col("pos") - F.col("k"))  # phrases given by the caller
    whole = begun.groupBy("phrase_id", key, "begin").agg(F.count(F.lit(1)).alias("met"), F.first("len").alias("len")).filter("met = len")
    return whole.groupBy("phrase_id", key).agg(F.count(F.lit(1)).alias("freq"))


def highlighted(text: Column, terms: list[str]) -> Column:
    """The whole text with ``<mark>`` around each of the terms, case ignored."""
    import re

    pattern = "|".join(re.escape(t) for t in sorted(terms, key=len, reverse=True))
    return F.regexp_replace(text, rf"(?i)\b({pattern})\b", "<mark>$1</mark>") if terms else text


def wildcard_counts(rows: DataFrame, needle: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, hits) of the rows whose text holds ``needle`` anywhere, case ignored."""
    import re

    low = F.lower(F.col(text))
    hits = F.size(F.regexp_extract_all(low, F.lit(re.escape(needle.lower())), F.lit(0))).cast("long")
    return rows.filter(low.contains(needle.lower())).select(key, hits.alias("hits"))
