"""Registered queries of the subpackage, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.p1_splits import clean_id, grouped_splits, related_queries, split_shares
from tidemark.llm.p2_boilerplate import main_body
from tidemark.llm.p3_mail_text import new_text
from tidemark.llm.p4_borda import borda_points, borda_ranking, first_of_each
from tidemark.llm.p5_near_duplicates import duplicate_classes, expand_pairs, near_duplicates
from tidemark.llm.p6_distinctive import term_weights
from tidemark.llm.p7_encode import encoded, token_counts
from tidemark.llm.p8_mixing import mixed_sources
from tidemark.llm.p9_residue import residue
from tidemark.session import spread
from tidemark.sources.tables import table

SCORES = ("okapi_tf", "bm25", "laplace", "jm")


def p1_split(spark: SparkSession, d: str) -> DataFrame:
    out = grouped_splits(table(spark, d, "training_features"), table(spark, d, "split_targets"))
    return out.select("row_id", "group_id", "split")


def p1_shares(spark: SparkSession, d: str) -> DataFrame:
    return split_shares(p1_split(spark, d), table(spark, d, "split_targets"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    found = related_queries(table(spark, d, "training_features").filter("query_id is not null"))
    return found.select(F.col("component").alias("group_query_id"), F.col("vertex").alias("query_id"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return main_body(spread(table(spark, d, "page_text_table").select("page_id", "url", "title", "text")))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return new_text(spread(table(spark, d, "emails").select("email_id", "subject", "text", "from_addr", "received_at")))


def _points(spark: SparkSession, d: str) -> DataFrame:
    return borda_points(table(spark, d, "training_features"), "query_id", clean_id("doc_id"), SCORES)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    best = first_of_each(_points(spark, d), "query_id", 8)
    return best.select(F.col("query_id").cast("long").alias("query_id"), F.col("item").alias("doc_id"))


def p4_ranking(spark: SparkSession, d: str) -> DataFrame:
    out = borda_ranking(_points(spark, d), "query_id")
    return out.select("query_id", F.col("item").alias("doc_id"), "place", F.round("points", 9).alias("points"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = expand_pairs(*near_duplicates(spread(table(spark, d, "page_text_table").select("page_id", "text")), "page_id", "text"))
    return pairs.select(F.col("a").alias("page_id_a"), F.col("b").alias("page_id_b"))


def p5_classes(spark: SparkSession, d: str) -> DataFrame:
    return duplicate_classes(*near_duplicates(spread(table(spark, d, "page_text_table").select("page_id", "text")), "page_id", "text"))


def _weights(spark: SparkSession, d: str, min_tf: int) -> DataFrame:
    pages = table(spark, d, "page_text_table").select(F.lit("page").alias("kind"), F.col("page_id").alias("record_id"), "text")
    mails = table(spark, d, "emails").select(F.lit("email").alias("kind"), F.col("email_id").alias("record_id"), "text")
    return term_weights(pages.unionByName(mails), min_tf)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _weights(spark, d, 3).filter("df <= 5").select("kind", "record_id", "term")


def p6_weights(spark: SparkSession, d: str) -> DataFrame:
    return _weights(spark, d, 1).withColumn("weight", F.round("weight", 8))


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return encoded(spread(table(spark, d, "documents").select("doc_id", "text")))


def _mix(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    sized = token_counts(spread(table(spark, d, "documents").select("doc_id", "source", "text")), keep=("source",))
    return mixed_sources(sized, table(spark, d, "mix_targets"))


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    """Documents with their copies, and the share that their source reached."""
    taken, report = _mix(spark, d)
    return taken.join(F.broadcast(report.select("source", "target_share", "actual_share")), "source")  # a row for each target


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d)[1]


def p9_labels(spark: SparkSession, d: str) -> DataFrame:
    return residue(spread(table(spark, d, "documents").select("doc_id", "text", "origin", "source")), origin="origin", source="source").withColumnRenamed("id", "doc_id")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return p9_labels(spark, d).select("doc_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p1_found, p1_split, p1_shares, p2_found, p3_found, p4_found, p4_ranking, p5_found, p5_classes, p6_found, p6_weights, p7_ids, p8_mix, p8_shares, p9_found, p9_labels)
}

_CLEAN = "nullif(upper(regexp_replace(doc_id, '\\s+', '', 'g')), '')"
_POINTS = (
    f"c as (select query_id, {_CLEAN} did, " + ", ".join(f"case when isnan({s}) or isinf({s}) then null else {s} end {s}" for s in SCORES) + " from training_features), "
    "i as (select query_id, did doc_id, " + ", ".join(f"max({s}) {s}" for s in SCORES) + " from c where query_id is not null and did is not null group by query_id, did), "
    "n as (select *, count(*) over (partition by query_id) n from i), "
    "k as (select query_id, doc_id, n, " + ", ".join(f"case when {s} is null then (n + 1) / 2 else (rank() over (partition by query_id order by {s} desc nulls last) + count({s}) over (partition by query_id order by {s} desc nulls last range between unbounded preceding and current row)) / 2 end r_{s}" for s in SCORES) + " from n), "
    "p as (select query_id, doc_id, n, round(" + " + ".join(f"n - r_{s}" for s in SCORES) + ", 9) points from k), "
    "o as (select *, row_number() over (partition by query_id order by points desc, doc_id) place from p)"
)
_WORDS = "regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')"
_TERMS = f"""
d as (select distinct 'page' kind, page_id record_id, text from page_text_table union all select distinct 'email', email_id, text from emails),
t as (select kind, record_id, unnest({_WORDS}) term from d),
f as (select kind, record_id, term, count(*) tf from t group by all),
g as (select kind, term, count(*) df from f group by all)"""

#: The queries whose definition SQL can state over whole tables.
ORACLES: dict[str, str] = {
    "p1_found": f"""with recursive x as (select distinct query_id q, {_CLEAN} did from training_features where query_id is not null),
e as (select distinct a.q a, b.q b from x a join x b on a.did = b.did and a.q <> b.q),
r as (select q, q g from (select distinct q from x) union select e.b, r.g from r join e on r.q = e.a)
select min(g)::bigint group_query_id, q::bigint query_id from r group by q having min(g) <> q""",
    "p4_found": f"with {_POINTS} select query_id::bigint query_id, doc_id from o where place = 1 and n >= 8",
    "p4_ranking": f"with {_POINTS} select query_id, doc_id, place, points from o",
    "p5_found": f"""with d as (select distinct page_id, {_WORDS} w from page_text_table where text is not null),
s as (select distinct page_id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) s from d where len(w) >= 3),
n as (select page_id, count(*) n from s group by all),
j as (select a.page_id a, b.page_id b, count(*) c from s a join s b on a.s = b.s and a.page_id < b.page_id group by all)
select a page_id_a, b page_id_b from j join n x on x.page_id = a join n y on y.page_id = b where c >= 0.6 * (x.n + y.n - c)""",
    "p6_found": f"with {_TERMS} select kind, record_id, term from f join g using (kind, term) where tf >= 3 and df <= 5",
    "p6_weights": f"""with {_TERMS}, l as (select kind, record_id, sum(tf) dl from f group by all), s as (select kind, count(*) n, (select sum(dl) from l where l.kind = d.kind) / count(*) avgdl from d group by kind)
select kind, record_id, term, tf, df, round(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl)), 8) weight from f join g using (kind, term) join l using (kind, record_id) join s using (kind)""",
}
