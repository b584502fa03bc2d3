"""Evaluators against hand-computed values and plain Python."""

import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.operators import evaluation as ev

RUN = [(1, "a", 1, 5.0), (1, "b", 2, 4.0), (1, "c", 3, 3.0), (1, "d", 4, 2.0), (1, "e", 5, 1.0)]
QRELS = [(1, "x", "a", 1.0), (1, "x", "c", 2.0), (1, "x", "z", 1.0), (1, "x", "b", 0.0), (1, "y", "d", None)]


@pytest.fixture(scope="module")
def run(spark):
    return spark.createDataFrame(RUN, "query_id int, doc_id string, rank long, score double")


@pytest.fixture(scope="module")
def grades(spark):
    from pyspark.sql import functions as F

    q = spark.createDataFrame(QRELS, "query_id int, assessor string, doc_id string, grade double")
    return ev.summed_grades(q).withColumn("pos", F.col("doc_id"))


def test_average_precision(run, grades):
    assert ev.average_precision(ev.judged(run, grades)).first().ap == pytest.approx((1 + 2 / 3) / 3)


def test_graded_average_precision(run, grades):
    assert ev.graded_average_precision(run, grades).first().ap == pytest.approx((1 * 1 / 1 + 2 * 2 / 3) / 4)


@pytest.mark.parametrize("beyond,at10", [("pad", 0.2), ("zero", 0.0), ("skip", None)])
def test_cutoffs(run, grades, beyond, at10):
    got = {r.k: r for r in ev.at_cutoffs(ev.judged(run, grades), (5, 10), beyond).collect()}
    assert got[5].precision == pytest.approx(0.4) and got[5].recall == pytest.approx(2 / 3)
    assert got[5].f1 == pytest.approx(2 * 0.4 * (2 / 3) / (0.4 + 2 / 3))
    assert (got[10].precision if 10 in got else None) == (pytest.approx(at10) if at10 is not None else None)


def test_r_precision(run, grades):
    assert ev.r_precision(ev.judged(run, grades)).first().rprec == pytest.approx(2 / 3)


def test_ndcg(run, grades):
    dcg = 1 + 2 / math.log2(3)
    judged = 1 + 0 + 2 / math.log2(3) + 0 + 1 / math.log2(5)  # a, b, c, d, z in listed order
    retrieved = 2 + 1 / math.log2(2)
    assert ev.ndcg(run, grades).first().ndcg == pytest.approx(dcg / judged)
    assert ev.ndcg(run, grades, "retrieved").first().ndcg == pytest.approx(dcg / retrieved)


def test_interpolation_and_curve(run, grades):
    j = ev.judged(run, grades)
    got = {round(r.level, 1): r.precision for r in ev.interpolated(j).collect()}
    assert got[0.0] == 1.0 and got[0.3] == 1.0 and got[0.6] == pytest.approx(2 / 3) and got[0.7] == 0.0
    curve = [(r.rank, r.monotone) for r in ev.precision_recall_curve(j).orderBy("rank").collect()]
    assert curve == [(1, 1.0), (3, pytest.approx(2 / 3))]


def test_majority(spark):
    votes = [(1, "a", "d1", 2.0), (1, "b", "d1", 2.0), (1, "c", "d1", 0.0), (1, "a", "d2", 0.0), (1, "b", "d2", 1.0), (1, "c", "d2", 2.0), (1, "a", "d3", 0.0), (1, "b", "d3", 0.0), (1, "c", "d3", 0.0), (1, "a", "d4", None)]
    got = ev.majority_grades(spark.createDataFrame(votes, "query_id int, assessor string, doc_id string, grade double"))
    assert {r.doc_id: r.grade for r in got.collect()} == {"d1": 2.0, "d2": 1.0, "d3": 0.0}


def test_summary_counts_queries_without_relevant_documents(spark, run, grades):
    other = run.unionByName(spark.createDataFrame([(2, "q", 1, 1.0)], run.schema))
    row = ev.summary(ev.judged(other, grades), other).first()
    assert (row.n_queries, row.n_relevant_queries, row.relevant, row.relevant_retrieved) == (2, 1, 3, 2)
    assert row.map_all == pytest.approx(row.map_relevant / 2)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2), st.integers(0, 2)), min_size=1, max_size=12))
def test_pair_counts_equal_the_pair_loop(spark, rows):
    got = ev.pair_counts(spark.createDataFrame(rows, "q int, c int"), "q", "c").first()
    both = same_q = same_c = none = 0
    for i, (q, c) in enumerate(rows):
        for p, d in rows[i:]:
            both, same_q, same_c, none = both + (q == p and c == d), same_q + (q == p and c != d), same_c + (q != p and c == d), none + (q != p and c != d)
    assert (got.same_both, got.same_query, got.same_cluster, got.neither) == (both, same_q, same_c, none)
    assert got.accuracy == pytest.approx((both + none) / (len(rows) * (len(rows) + 1) / 2))
