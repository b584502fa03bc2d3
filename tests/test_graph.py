"""Link analysis on a graph of four vertices, and properties."""

import pytest

from tidemark.operators import graph as gr

EDGES = [("A", "B"), ("A", "C"), ("B", "C"), ("C", "A"), ("A", "D"), ("A", "B"), ("D", "D"), (None, "A")]


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame(EDGES, "src string, dst string")


def python_pagerank(edges, steps):
    edges = {(a, b) for a, b in edges if a and b and a != b}
    nodes = {x for e in edges for x in e}
    out = {v: sum(a == v for a, _ in edges) for v in nodes}
    pr = {v: 1 / len(nodes) for v in nodes}
    for _ in range(steps):
        sink = sum(p for v, p in pr.items() if not out[v])
        pr = {v: 0.15 / len(nodes) + 0.85 * sink / len(nodes) + 0.85 * sum(pr[a] / out[a] for a, b in edges if b == v) for v in nodes}
    return pr


def test_pagerank_with_a_sink(edges):
    got = {r.id: r.pr for r in gr.pagerank(edges, 9).collect()}
    assert got == pytest.approx(python_pagerank(EDGES, 9)) and sum(got.values()) == pytest.approx(1)


def test_pagerank_converges(edges):
    got = {r.id: r.pr for r in gr.pagerank(edges, tolerance=1e-6).collect()}
    assert got == pytest.approx(python_pagerank(EDGES, 200), abs=1e-5)


def test_hits_norms(edges):
    rows = gr.hits(edges, 5).collect()
    assert sum(r.auth**2 for r in rows) == pytest.approx(1) and sum(r.hub**2 for r in rows) == pytest.approx(1)
    assert max(rows, key=lambda r: r.hub).id == "A"


def test_degrees_sinks_lists(edges):
    e = gr.distinct_edges(edges)
    assert {tuple(r) for r in gr.degrees(e).collect()} == {("A", 1, 3), ("B", 1, 1), ("C", 2, 1), ("D", 1, 0)}
    assert [r.id for r in gr.sinks(e).collect()] == ["D"]
    lists = {r.id: (r.in_links, r.out_links) for r in gr.link_lists(edges).collect()}
    assert lists["A"] == (["C"], ["B", "C", "D"]) and lists["D"] == (["A"], [])


def test_sets(spark, edges):
    root = spark.createDataFrame([("B",)], "id string")
    assert {r.id for r in gr.base_set(edges, root).collect()} == {"A", "B", "C"}
    keep = spark.createDataFrame([("A",), ("C",)], "id string")
    assert {tuple(r) for r in gr.induced(edges, keep).collect()} == {("A", "C"), ("C", "A")}
    assert {tuple(r) for r in gr.without_vertices(gr.distinct_edges(edges), root).collect()} == {("A", "C"), ("A", "D"), ("C", "A")}


def test_bfs(spark, edges):
    seeds = spark.createDataFrame([("B",)], "id string")
    assert {tuple(r) for r in gr.bfs(edges, seeds).collect()} == {("B", 0), ("C", 1), ("A", 2), ("D", 3)}
    assert {r.id for r in gr.bfs(edges, seeds, 1).collect()} == {"B", "C"}


def test_empty_graph(spark):
    none = spark.createDataFrame([], "src string, dst string")
    assert gr.pagerank(none, 2).count() == 0 and gr.hits(none, 2).count() == 0


def test_base_set_200_keeps_in_links_from_the_sixth_on(spark, small):
    from tidemark.plans import graph as plans

    root, links = plans._root(spark, small), plans.successors(spark, small)
    into = {r.src for r in links.join(root.withColumnRenamed("id", "dst"), "dst", "left_semi").collect()}
    count = links.join(root.withColumnRenamed("id", "dst"), "dst", "left_semi").groupBy("dst").count().agg({"count": "max"}).first()[0]
    assert 5 < count <= 200
    assert into <= {r.id for r in plans.QUERIES["base_set_200"](spark, small).collect()}
