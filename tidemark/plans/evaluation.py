"""Evaluation of a run made from the feature table against the grades."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import evaluation as ev
from tidemark.operators.ltr import finite
from tidemark.operators.ranking import top
from tidemark.plans.ctes import CLEAN, GRADES, JUDGED, RUN
from tidemark.sources.tables import table


def clean_doc() -> Column:
    return F.nullif(F.upper(F.regexp_replace("doc_id", r"\s+", "")), F.lit(""))


def run(s: SparkSession, d: str, depth: int = 1000) -> DataFrame:
    """Documents of each query by their best known BM25."""
    rows = table(s, d, "training_features").select("query_id", clean_doc().alias("doc_id"), finite(F.col("bm25")).alias("score"))
    best = rows.filter("query_id is not null and doc_id is not null and score is not null").groupBy("query_id", "doc_id").agg(F.max("score").alias("score"))
    return top(best, depth)


def grades(s: SparkSession, d: str) -> DataFrame:
    """Grades added up for each document; ``pos`` is their listed order."""
    clean = table(s, d, "qrels").withColumn("doc_id", clean_doc()).filter("query_id is not null and doc_id is not null")
    return ev.summed_grades(clean).withColumn("pos", F.col("doc_id"))


def judged(s: SparkSession, d: str) -> DataFrame:
    return ev.judged(run(s, d), grades(s, d))


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*(F.round(c, 6).alias(c) if t == "double" else c for c, t in df.dtypes))


def _majority(s: SparkSession, d: str) -> DataFrame:
    clean = table(s, d, "qrels").withColumn("doc_id", clean_doc()).filter("doc_id is not null")
    return ev.majority_grades(clean)


def _octant() -> Column:
    """A cluster by the signs of the first four coordinates."""
    return sum(((F.get("embedding", F.lit(i)) > 0).cast("int") * 2**i for i in range(4)), F.lit(0))


def _pairs(s: SparkSession, d: str) -> DataFrame:
    return ev.pair_counts(table(s, d, "embeddings").select("label", _octant().alias("cluster")), "label", "cluster")


def _accuracy(tie: int):
    def query(s: SparkSession, d: str) -> DataFrame:
        """The share of six header flags that are set as the probability of spam."""
        flags = sum((F.coalesce(c, F.lit(0)) for c in FLAGS[1:]), F.coalesce(FLAGS[0], F.lit(0)))
        rows = table(s, d, "emails").filter("email_id is not null").select("email_id", "spam", (flags / 6).alias("p")).distinct()
        return _rounded(ev.accuracy(rows, "p", "spam", tie))

    return query


FLAGS = ("weird_char", "weird_addr", "weird_sbj", "weird_target", "weird_content", "weird_msg_id")

QUERIES = {
    "eval_run": lambda s, d: _rounded(run(s, d)),
    "majority_qrels": _majority,
    "summed_qrels": lambda s, d: grades(s, d).drop("pos"),
    "eval_ap": lambda s, d: _rounded(ev.average_precision(judged(s, d))),
    "eval_ap_graded": lambda s, d: _rounded(ev.graded_average_precision(run(s, d), grades(s, d))),
    "eval_at_k": lambda s, d: _rounded(ev.at_cutoffs(judged(s, d))),
    "eval_at_k_zero": lambda s, d: _rounded(ev.at_cutoffs(judged(s, d), beyond="zero")),
    "eval_at_k_skip": lambda s, d: _rounded(ev.at_cutoffs(judged(s, d), beyond="skip")),
    "eval_rprec": lambda s, d: _rounded(ev.r_precision(judged(s, d))),
    "eval_ndcg": lambda s, d: _rounded(ev.ndcg(run(s, d), grades(s, d))),
    "eval_ndcg_ret": lambda s, d: _rounded(ev.ndcg(run(s, d).join(grades(s, d).select("query_id").distinct(), "query_id", "left_semi"), grades(s, d), "retrieved")),
    "eval_11pt": lambda s, d: _rounded(ev.interpolated(judged(s, d))),
    "eval_pr_curve": lambda s, d: _rounded(ev.precision_recall_curve(judged(s, d))),
    "eval_summary": lambda s, d: _rounded(ev.summary(judged(s, d), run(s, d))),
    "cluster_pair_eval": lambda s, d: _rounded(_pairs(s, d)),
    "eval_at_k_wide": lambda s, d: _rounded(ev.at_cutoffs(judged(s, d), ev.CUTOFFS_WIDE)),
    "eval_rprec_equal": lambda s, d: _rounded(ev.r_precision_equal(judged(s, d))),
    "eval_rprec_graded": lambda s, d: _rounded(ev.r_precision_graded(judged(s, d), grades(s, d))),
    "eval_pr_curve_start": lambda s, d: _rounded(ev.precision_recall_curve(judged(s, d), start=True)),
    "class_accuracy": _accuracy(1),
    "class_accuracy_tie_0": _accuracy(0),
    "eval_grade_counts": lambda s, d: ev.relevant_counts(grades(s, d)),
}

_K = "(values (5), (10), (20), (50), (100)) t(k)"
_ENDS = "e as (select query_id, max(rank) n_ret, sum(rel) rel_ret, max(n_rel) n_rel from j group by all)"
_AT = "select query_id, k::bigint k, round(hits / k, 6) as precision, round(coalesce(hits / nullif(n_rel, 0), 0), 6) recall, round(case when hits > 0 and n_rel > 0 then 2 * (hits / k) * (hits / n_rel) / (hits / k + hits / n_rel) else 0 end, 6) f1 from (select e.query_id, k, n_rel, n_ret, case when k > n_ret then {past} else (select num_rel from j where j.query_id = e.query_id and rank = k) end hits from e cross join {k} {where})"
_DCG = "sum(case when {r} = 1 then grade else grade / log2({r}) end)"

_K_WIDE = "(values " + ", ".join(f"({k})" for k in ev.CUTOFFS_WIDE) + ") t(k)"
_ACCURACY = "with m as (select distinct email_id, spam, (" + " + ".join(f"coalesce({c}, 0)" for c in FLAGS) + ") / 6 p from emails where email_id is not null) select count(*) n, round(avg((case when p = 0.5 then {tie} when p > 0.5 then 1 else 0 end = spam)::int), 6) accuracy from m where p is not null and spam is not null"

ORACLES = {
    "eval_run": f"with {RUN} select query_id, doc_id, rank, round(score, 6) score from run",
    "majority_qrels": f"with c as (select query_id, {CLEAN} did, grade from qrels), v as (select query_id, did doc_id, grade, count(*) n from c where grade is not null and did is not null group by query_id, did, grade), r as (select *, row_number() over (partition by query_id, doc_id order by n desc, grade) k from v) select query_id, doc_id, case when n = 1 then 1.0::double else grade end grade from r where k = 1",
    "summed_qrels": f"with {GRADES} select query_id, doc_id, grade from grades",
    "eval_ap": f"with {JUDGED} select query_id, round(coalesce(sum(rel * precision) / nullif(max(n_rel), 0), 0), 6) ap from j group by all",
    "eval_ap_graded": f"with {RUN}, {GRADES}, t as (select query_id, sum(grade) n from grades group by all having sum(grade) > 0), g as (select run.*, n, coalesce(grade, 0) grade from run join t using (query_id) left join (select query_id, doc_id, grade from grades) using (query_id, doc_id)), c as (select *, sum(grade) over (partition by query_id order by rank rows unbounded preceding) - grade so_far from g) select query_id, round(sum(grade * (1 + so_far) / rank) / max(n), 6) ap from c group by all",
    "eval_at_k": f"with {JUDGED}, {_ENDS} " + _AT.format(past="rel_ret", k=_K, where=""),
    "eval_at_k_zero": f"with {JUDGED}, {_ENDS} " + _AT.format(past="0", k=_K, where=""),
    "eval_at_k_skip": f"with {JUDGED}, {_ENDS} " + _AT.format(past="0", k=_K, where="where k <= n_ret"),
    "eval_rprec": f"with {JUDGED} select query_id, round(coalesce(max(num_rel) filter (rank = n_rel), sum(rel)) / max(n_rel), 6) rprec from j where n_rel > 0 group by all",
    "eval_ndcg": f"with {RUN}, {GRADES}, m as (select run.query_id, rank, coalesce(grade, 0) grade from run left join grades using (query_id, doc_id)), d as (select query_id, {_DCG.format(r='rank')} dcg from m group by all), o as (select query_id, grade, row_number() over (partition by query_id order by pos, doc_id) i from grades), b as (select query_id, {_DCG.format(r='i')} idcg from o group by all) select query_id, round(coalesce(dcg / nullif(idcg, 0), 0), 6) ndcg from d join b using (query_id)",
    "eval_ndcg_ret": f"with {RUN}, {GRADES}, m as (select run.query_id, rank, coalesce(grade, 0) grade from run left join grades using (query_id, doc_id) where query_id in (select query_id from grades)), d as (select query_id, {_DCG.format(r='rank')} dcg from m group by all), o as (select query_id, grade, row_number() over (partition by query_id order by grade desc, rank) i from m), b as (select query_id, {_DCG.format(r='i')} idcg from o group by all) select query_id, round(coalesce(dcg / nullif(idcg, 0), 0), 6) ndcg from d join b using (query_id)",
    "eval_11pt": f"with {JUDGED}, b as (select *, max(precision) over (partition by query_id order by rank rows between current row and unbounded following) best from j where n_rel > 0) select query_id, (x / 10)::double as level, round(coalesce(max(best) filter (recall >= x / 10), 0), 6) as precision from b cross join range(11) r(x) group by all",
    "eval_pr_curve": f"with {JUDGED} select query_id, rank, round(recall, 6) recall, round(precision, 6) as precision, round(min(precision) over (partition by query_id order by rank rows unbounded preceding), 6) monotone from j where rel = 1 and n_rel > 0",
    "eval_summary": f"with {JUDGED}, p as (select query_id, count(*) ret, max(n_rel) n_rel, sum(rel) rr, sum(rel * precision) sp from j group by all having max(n_rel) > 0) select (select count(distinct query_id) from run) n_queries, count(*) n_relevant_queries, sum(ret)::bigint retrieved, sum(n_rel)::bigint relevant, sum(rr)::bigint relevant_retrieved, round(sum(sp / n_rel) / (select count(distinct query_id) from run), 6) map_all, round(sum(sp / n_rel) / count(*), 6) map_relevant from p",
    "cluster_pair_eval": "with e as (select vec_id, label, " + " + ".join(f"(embedding[{i + 1}] > 0)::int * {2**i}" for i in range(4)) + " c from embeddings), p as (select a.label = b.label q, a.c = b.c k from e a join e b on a.vec_id <= b.vec_id) select count(*) filter (q and k) same_both, count(*) filter (q and not k) same_query, count(*) filter (k and not q) same_cluster, count(*) filter (not q and not k) neither, round(count(*) filter (q = k) / count(*), 6) accuracy from p",
    "eval_at_k_wide": f"with {JUDGED}, {_ENDS} " + _AT.format(past="rel_ret", k=_K_WIDE, where=""),
    "eval_rprec_equal": f"with {JUDGED} select query_id, round(coalesce(max(precision) filter (num_rel > 0 and abs(precision - recall) < 1e-12), 0), 6) rprec from j where n_rel > 0 group by all",
    "eval_rprec_graded": f"with {JUDGED}, w as (select query_id, sum(grade) r from grades group by all having sum(grade) > 0), e as (select j.query_id, max(r) r, max(rank) n, sum(rel) hits, coalesce(max(precision) filter (rank = floor(r)), 0) p, coalesce(max(precision) filter (rank = floor(r) + 1), 0) q from j join w using (query_id) group by all) select query_id, round(case when r > n then hits / r else (1 - (r - floor(r))) * p + (r - floor(r)) * q end, 6) rprec from e",
    "eval_pr_curve_start": f"with {JUDGED}, c as (select query_id, rank, recall, precision from j where rel = 1 and n_rel > 0 union all select distinct query_id, 0, 0, 1 from j where n_rel > 0) select query_id, rank, round(recall, 6) recall, round(precision, 6) as precision, round(min(precision) over (partition by query_id order by rank rows unbounded preceding), 6) monotone from c",
    "class_accuracy": _ACCURACY.format(tie=1),
    "class_accuracy_tie_0": _ACCURACY.format(tie=0),
    "eval_grade_counts": f"with {GRADES} select * from nrel",
}
