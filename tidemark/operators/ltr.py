"""Learning to rank: features, normalization, models and ranked predictions."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.analysis import index_terms
from tidemark.operators.blocks import Block, Parts, Stats, each_match, six_places
from tidemark.operators.index import Index
from tidemark.operators.ranking import MODELS, bm25, matches, okapi
from tidemark.session import materialize

FEATURES = ("okapi_tf", "tf_idf", "bm25", "laplace", "jm", "title_unique_term", "text_unique_term", "text_term_appeared_in_query_len", "title_term_appeared_in_query_len", "doc_len")
SCORES = FEATURES[:5]


def lexical_features(index: Index, queries: DataFrame) -> DataFrame:
    """(query_id, doc_id, five scores, share of the query's terms present, doc_len) of each query and matching document.

    One pass over the matches: the five models differ in their summand only. ``queries`` are sets
    (query_id, term, qtf = 1).
    """
    sizes = queries.groupBy("query_id").agg(F.count(F.lit(1)).alias("q_len"))
    met = matches(index, queries)
    back = 0.5 * F.col("total_len") / F.col("vocabulary")
    met = met.groupBy("query_id", "doc_id").agg(
        F.sum(okapi()).alias("okapi_tf"),
        F.sum(okapi() * F.log2(F.col("n_docs") / F.col("df"))).alias("tf_idf"),
        F.sum(bm25()).alias("bm25"),
        F.sum(F.log2(F.col("tf") + 1)).alias("lap"),
        F.sum(F.log2(back + 0.5 * F.col("tf") / F.col("dl"))).alias("jm_met"),
        F.count(F.lit(1)).alias("met"),
        F.first("dl").alias("doc_len"),
        F.first("vocabulary").alias("vocabulary"),
        F.first(back).alias("back"),
    )
    full = met.join(sizes, "query_id")
    return full.select("query_id", "doc_id", "okapi_tf", "tf_idf", "bm25", (F.col("lap") - F.col("q_len") * F.log2(F.col("doc_len") + F.col("vocabulary"))).alias("laplace"), (F.col("jm_met") + (F.col("q_len") - F.col("met")) * F.log2("back")).alias("jm"), (F.col("met") / F.col("q_len")).alias("text_term_appeared_in_query_len"), "doc_len")


def page_features(pages: DataFrame, queries: DataFrame, key: str = "doc_id", title: str = "title", text: str = "text") -> DataFrame:
    """(query_id, key, title_unique_term, text_unique_term, text_term_appeared_in_query_len, title_term_appeared_in_query_len).

    Of each query and each page with one of its terms in the title or text: the numbers of distinct
    terms of title and text, and the shares of the query's terms that they hold. ``queries`` are
    sets (query_id, term); null titles and texts have no terms. The distinct terms are taken
    within a page's row, so one shuffle meets them with the queries.
    """
    of = lambda c: F.array_distinct(F.coalesce(index_terms(c), F.array().cast("array<string>")))
    split = pages.select(key, of(title).alias("_t"), of(text).alias("_x"))
    sizes = [F.size("_t").alias("title_unique_term"), F.size("_x").alias("text_unique_term")]
    wide = split.select(key, *sizes, "_t", "_x", F.explode(F.array_union("_t", "_x")).alias("term"))
    words = queries.select("query_id", "term").distinct()
    held = wide.select(key, "title_unique_term", "text_unique_term", "term", F.array_contains("_t", F.col("term")).cast("int").alias("_in_title"), F.array_contains("_x", F.col("term")).cast("int").alias("_in_text"))
    met = held.join(words, "term").groupBy("query_id", key).agg(F.max("title_unique_term").alias("title_unique_term"), F.max("text_unique_term").alias("text_unique_term"), F.sum("_in_text").alias("_x"), F.sum("_in_title").alias("_t"))
    n = words.groupBy("query_id").agg(F.count(F.lit(1)).alias("_n"))
    return met.join(n, "query_id").select("query_id", key, "title_unique_term", "text_unique_term", (F.col("_x") / F.col("_n")).alias("text_term_appeared_in_query_len"), (F.col("_t") / F.col("_n")).alias("title_term_appeared_in_query_len"))


def _of_lists(block: Block, known: dict, stats: Stats):
    """The columns of :func:`lexical_features`, to six places, of the documents with one of a query's terms."""
    back = 0.5 * stats.total_len / stats.vocabulary
    weighted = {}
    for t, (doc, tf) in block.lists.items():
        dl, (df, ttf) = block.dl[doc], known[t]
        scores = [MODELS[m].weight(tf, dl, df, ttf, stats) for m in ("okapi_tf", "tf_idf_log2", "bm25", "laplace_log2")]
        weighted[t] = [doc.astype(np.int64), *scores, np.log2(back + 0.5 * tf / dl)]
    shorter = np.log2(block.dl + float(stats.vocabulary))

    def columns(met: list[str], q_len: int) -> tuple[np.ndarray, dict]:
        doc, *scores = (np.concatenate(x) for x in zip(*(weighted[t] for t in met)))
        count = np.bincount(doc, minlength=len(block.ids))
        docs = np.flatnonzero(count)
        count, dl = count[docs], block.dl[docs]
        tf_, idf, bm, lap, jm = (np.bincount(doc, x, len(block.ids))[docs] for x in scores)
        values = {"okapi_tf": tf_, "tf_idf": idf, "bm25": bm, "laplace": lap - q_len * shorter[docs], "jm": jm + (q_len - count) * np.log2(back), "text_term_appeared_in_query_len": count / q_len}
        return docs, {c: six_places(x) for c, x in values.items()} | {"doc_len": dl}

    return columns


def lexical_matches(parts: Parts, queries: DataFrame) -> DataFrame:
    """As :func:`lexical_features`, to six places, from an index in parts: no match becomes a row, only the result's rows do."""
    return each_match(parts, queries, _of_lists, "okapi_tf double, tf_idf double, bm25 double, laplace double, jm double, text_term_appeared_in_query_len double, doc_len long")


def _of_fields(block: Block, known: dict, stats: Stats):
    """The columns of :func:`page_features`, to six places, of the pages with one of a query's terms."""
    split = {t: (doc[tf & 1 > 0], doc[tf & 2 > 0]) for t, (doc, tf) in block.lists.items()}
    titles, texts = block.titles.astype(np.int32), ((block.dl - block.titles) // 2).astype(np.int32)

    def columns(met: list[str], q_len: int) -> tuple[np.ndarray, dict]:
        title, text = np.zeros(len(block.ids), np.int32), np.zeros(len(block.ids), np.int32)
        for t in met:
            title[split[t][0]] += 1
            text[split[t][1]] += 1
        docs = np.flatnonzero(title + text)
        values = {"title_unique_term": titles[docs], "text_unique_term": texts[docs], "text_term_appeared_in_query_len": six_places(text[docs] / q_len)}
        return docs, values | {"title_term_appeared_in_query_len": six_places(title[docs] / q_len)}

    return columns


def page_matches(parts: Parts, queries: DataFrame, key: str = "doc_id") -> DataFrame:
    """As :func:`page_features`, to six places, from an index in parts with titles."""
    return each_match(parts, queries, _of_fields, "title_unique_term int, text_unique_term int, text_term_appeared_in_query_len double, title_term_appeared_in_query_len double", key)


def fit_classifier(train: DataFrame, kind: str = "logistic", features: Sequence[str] = SCORES, label: str = "label"):
    """Relevant (a label above 0) against not, by logistic regression or a linear support vector machine."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LinearSVC, LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    made = LogisticRegression if kind == "logistic" else LinearSVC
    rows = train.filter(F.col(label).isNotNull()).withColumn("_y", (F.col(label) > 0).cast("double"))
    return Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="_x", handleInvalid="skip"), made(featuresCol="_x", labelCol="_y", regParam=0.01, maxIter=20)]).fit(rows)


def finite(x: Column) -> Column:
    """null for NaN and infinite values."""
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def normalized(rows: DataFrame, features: Sequence[str], group: str = "query_id") -> DataFrame:
    """``features`` as (x - mean) / mean absolute deviation within each group; 0 for a constant or unknown value.

    The statistics are two small aggregates joined back, so that no task holds a whole group.
    """
    clean = rows.select(*(finite(F.col(c).cast("double")).alias(c) if c in features else c for c in rows.columns))
    means = clean.groupBy(group).agg(*(F.avg(c).alias(f"_m_{c}") for c in features))
    with_means = clean.join(means, group)
    spreads = with_means.groupBy(group).agg(*(F.avg(F.abs(F.col(c) - F.col(f"_m_{c}"))).alias(f"_d_{c}") for c in features))
    full = with_means.join(spreads, group)
    values = {c: F.coalesce((F.col(c) - F.col(f"_m_{c}")) / F.nullif(f"_d_{c}", F.lit(0.0)), F.lit(0.0)) for c in features}
    return full.withColumns(values).select(*rows.columns)


def query_split(rows: DataFrame, test: Column) -> tuple[DataFrame, DataFrame]:
    """(train, test) by a condition on the query."""
    return rows.filter(~test), rows.filter(test)


def fit_linear(train: DataFrame, features: Sequence[str] = SCORES, label: str = "label"):
    """Least squares by the normal equations: one pass, a matrix of the features' size."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    stages = [VectorAssembler(inputCols=list(features), outputCol="_x", handleInvalid="skip"), LinearRegression(featuresCol="_x", labelCol=label, predictionCol="score", solver="normal")]
    return Pipeline(stages=stages).fit(train.filter(F.col(label).isNotNull()))


def fit_rank_svm(train: DataFrame, features: Sequence[str] = SCORES, label: str = "label", group: str = "query_id", c: float = 10.0, buckets: int = 8):
    """Linear SVM on differences of relevant and other rows of a query.

    Each relevant row meets, in its query, the rows of one hashed bucket of the others and not
    all of them, so the differences grow with the rows and not with their square.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LinearSVC
    from pyspark.ml.feature import VectorAssembler

    marked = train.withColumn("_h", F.xxhash64(*features))
    per = marked.groupBy(group).agg(F.count(F.lit(1)).alias("_n"))
    marked = marked.join(per, group).withColumn("_b", F.pmod("_h", F.greatest(F.lit(1), F.floor(F.col("_n") / buckets))))
    up = marked.filter(F.col(label) > 0).select(group, "_b", *(F.col(f).alias(f"a_{f}") for f in features))
    down = marked.filter(F.col(label) <= 0).select(group, "_b", *(F.col(f).alias(f"b_{f}") for f in features))
    diff = up.join(down, [group, "_b"]).select(*((F.col(f"a_{f}") - F.col(f"b_{f}")).alias(f) for f in features))
    signs = diff.withColumn("y", F.lit(1.0)).unionByName(diff.select(*((-F.col(f)).alias(f) for f in features)).withColumn("y", F.lit(0.0)))
    stages = [VectorAssembler(inputCols=list(features), outputCol="_x", handleInvalid="skip"), LinearSVC(featuresCol="_x", labelCol="y", regParam=1.0 / c, maxIter=20, fitIntercept=False)]
    return Pipeline(stages=stages).fit(materialize(signs))


def scored_by_svm(model, rows: DataFrame, features: Sequence[str] = SCORES) -> DataFrame:
    """``rows`` with ``score`` = the model's weights times the features."""
    weights = model.stages[-1].coefficients.toArray()
    total = F.lit(0.0)
    for w, f in zip(weights, features):
        total = total + float(w) * F.col(f)
    return rows.withColumn("score", total)
