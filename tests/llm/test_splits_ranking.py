"""Splits, components and Borda ranking against brute force."""

import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tidemark.llm.components import components
from tidemark.llm.p1_splits import greedy_runs, grouped_splits, related_queries
from tidemark.llm.p4_borda import borda_points, borda_ranking, first_of_each


def brute(edges):
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None:
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    return {(v, root(v)) for v in parent if root(v) != v}


@pytest.mark.parametrize("merge_rows,fan_in,parts", [(10**6, 8, 6), (20, 2, 6), (3, 2, 5)])
def test_components_by_merging_and_by_stars(spark, merge_rows, fan_in, parts):
    rng = random.Random(parts + merge_rows)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(35)] + [(100 + i, 101 + i) for i in range(25)] + [(None, 1), (5, 5), (200, 201), (200, 201)]
    df = spark.createDataFrame(edges, "a long, b long").repartition(parts)
    got = {tuple(r) for r in components(df, merge_rows, fan_in).collect()}
    assert got == brute(e for e in edges if e[0] != e[1])


def test_components_of_nothing(spark):
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def naive_greedy(sizes, shares):
    total = sum(s * c for s, c in sizes)
    short = [x * total for _, x in shares]
    out = defaultdict(lambda: [0] * len(shares))
    for size, count in sorted(sizes, reverse=True):
        for _ in range(count):
            j = max(range(len(short)), key=lambda i: (short[i], -i))
            short[j] -= size
            out[size][j] += 1
    return dict(out)


@pytest.mark.parametrize("seed", range(6))
def test_greedy_runs_equal_one_by_one(seed):
    rng = random.Random(seed)
    sizes = [(s, rng.choice([1, 3, 70, 500])) for s in rng.sample(range(1, 90), 12)]
    shares = [("train", 0.8), ("test", 0.125), ("valid", 0.075)]
    assert dict(greedy_runs(sizes, shares)) == naive_greedy(sizes, shares)


ROWS = [
    (1, 10, "A-1"), (2, 10, "a -1 "), (3, 11, "B"), (4, 12, "\tb"), (5, 13, "C"), (6, None, "c"), (7, None, None), (8, 14, None), (9, 14, "  "), (10, 15, "D"), (11, 15, "D"), (11, 15, "D"), (12, None, "Z"), (13, None, "z"),
]


def rows_of(spark, rows=ROWS):
    return spark.createDataFrame(rows, "row_id long, query_id int, doc_id string").withColumn("split", F.lit("old")).withColumn("n", F.lit(1))


def test_splits_keep_related_rows_together(spark):
    targets = spark.createDataFrame([("train", 0.8), ("valid", 0.1), ("test", 0.1)], "split_name string, target_share double")
    got = grouped_splits(rows_of(spark), targets).collect()
    assert len(got) == len(ROWS) and {r.n for r in got} == {1} and all(r.split in ("train", "valid", "test") for r in got)
    by = defaultdict(set)
    for r in got:
        by["q", r.query_id].add(r.split) if r.query_id else None
        doc = re.sub(r"\s", "", r.doc_id or "").upper()
        by["d", doc].add(r.split) if doc else None
    assert all(len(s) == 1 for s in by.values())
    assert len({r.group_id for r in got}) == 7


def test_related_queries(spark):
    got = {tuple(r) for r in related_queries(rows_of(spark).filter("query_id is not null")).collect()}
    assert got == {(12, 11)}


def test_splits_without_rows_or_targets(spark):
    targets = spark.createDataFrame([], "split_name string, target_share double")
    assert {r.split for r in grouped_splits(rows_of(spark), targets).collect()} == {None}
    assert grouped_splits(rows_of(spark, []), targets).count() == 0


def test_shares_are_met_with_a_hot_query(spark):
    rng = random.Random(1)
    rows = [(i, 1 if rng.random() < 0.33 else rng.randrange(2, 200), f"d{i}") for i in range(3000)]
    targets = spark.createDataFrame([("train", 0.6), ("test", 0.4)], "split_name string, target_share double")
    got = {r["split"]: r["count"] for r in grouped_splits(rows_of(spark, rows), targets).groupBy("split").count().collect()}
    assert got["train"] == pytest.approx(1800, abs=15)


SCORES = ["s", "t"]


def brute_borda(rows):
    best = defaultdict(dict)
    for g, item, *values in rows:
        if g is None or item is None:
            continue
        known = [v if v is not None and v == v and abs(v) != float("inf") else None for v in values]
        old = best[g].get(item)
        best[g][item] = known if old is None else [max((x for x in p if x is not None), default=None) for p in zip(old, known)]
    out = {}
    for g, items in best.items():
        n = len(items)
        for item in items:
            points = 0.0
            for k in range(len(SCORES)):
                v = items[item][k]
                present = [x[k] for x in items.values() if x[k] is not None]
                rank = (n + 1) / 2 if v is None else (sum(x > v for x in present) + 1 + sum(x >= v for x in present)) / 2
                points += n - rank
            out[g, item] = points
    return out


@pytest.mark.parametrize("group_rows", [1000, 10])
def test_borda_equals_brute_force_for_small_and_large_groups(spark, group_rows):
    rng = random.Random(3)
    value = lambda: rng.choice([None, float("nan"), float("-inf"), *[float(x) for x in range(6)]])
    rows = [(rng.choice([1, 1, 1, 2, 3, None]), rng.choice(["a", "b", "c", "d", "e", "f", "g", None]) , value(), value()) for _ in range(90)] + [(4, "x", None, None), (5, "only", 1.0, 2.0)]
    df = spark.createDataFrame(rows, "g int, item string, s double, t double").withColumn("points", F.lit("clash")).withColumn("n_items", F.lit(0))
    points = borda_points(df, "g", F.col("item"), SCORES, group_rows=group_rows)
    want = brute_borda(rows)
    assert {(r.g, r.item): r.points for r in points.collect()} == pytest.approx(want)
    first = {r.g: r.item for r in first_of_each(points, "g").collect()}
    ranked = {(r.g, r.place): r.item for r in borda_ranking(points, "g").collect()}
    for g in {k[0] for k in want}:
        order = sorted((-p, i) for (h, i), p in want.items() if h == g)
        assert first[g] == order[0][1] and [ranked[g, n + 1] for n in range(len(order))] == [i for _, i in order]


def test_weights_and_scales(spark):
    df = spark.createDataFrame([(1, "a", 1e9, 0.1), (1, "b", 5.0, 0.2), (1, "c", 4.0, 0.3)], "g int, item string, s double, t double")
    even = {r.item: r.points for r in borda_points(df, "g", F.col("item"), SCORES).collect()}
    assert even == {"a": 2.0, "b": 2.0, "c": 2.0}
    heavy = {r.item: r.points for r in borda_points(df, "g", F.col("item"), SCORES, [1.0, 2.0]).collect()}
    assert max(heavy, key=heavy.get) == "c"


def test_no_rows_to_rank(spark):
    df = spark.createDataFrame([], "g int, item string, s double, t double")
    assert borda_points(df, "g", F.col("item"), SCORES).count() == 0


def test_shares_of_the_splits(spark):
    from tidemark.llm.p1_splits import split_shares

    rows = spark.createDataFrame([("train",)] * 8 + [("test",)] * 2, "split string")
    targets = spark.createDataFrame([("train", 0.8), ("test", 0.1), ("test", 0.1), ("dev", 0.1), (None, 0.5)], "split_name string, target_share double")
    assert {tuple(r) for r in split_shares(rows, targets).collect()} == {("train", 0.8, 8, 0.8), ("test", 0.1, 2, 0.2), ("dev", 0.1, 0, 0.0)}
    assert {r.actual_share for r in split_shares(rows.limit(0), targets).collect()} == {0.0}
