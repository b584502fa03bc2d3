"""Link analysis over the order lines: suppliers to parts, and parts that follow each other in an order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import graph as gr
from tidemark.plans.ctes import BIPARTITE, DEGREES, SUCCESSOR, hits, pagerank
from tidemark.sources.tables import table

STEPS = 5
ROOT_SIZE = 7
#: Small, so that the test data have vertices of several blocks.
LINK_BLOCK = 20


def supplies(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "lineitem")
    return gr.distinct_edges(rows.select(F.concat(F.lit("s"), "l_suppkey").alias("src"), F.concat(F.lit("p"), "l_partkey").alias("dst")))


def successors(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    nxt = rows.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("l_partkey").alias("dst"))
    return gr.distinct_edges(rows.join(nxt, ["l_orderkey", "l_linenumber"]).select(F.col("l_partkey").alias("src"), "dst"))


def _rounded(df: DataFrame, places: int = 12) -> DataFrame:
    return df.select(*(F.round(c, places).alias(c) if t == "double" else c for c, t in df.dtypes))


def _root(s: SparkSession, d: str) -> DataFrame:
    """Parts of one size: a topic's root set."""
    return table(s, d, "part").filter(F.col("p_size") == ROOT_SIZE).select(F.col("p_partkey").alias("id"))


def _base(s: SparkSession, d: str) -> DataFrame:
    return gr.base_set(successors(s, d), _root(s, d), 5)


def _base_200(s: SparkSession, d: str) -> DataFrame:
    """The base set with the surveyed number of in-links (GR6), the operator's default."""
    return gr.base_set(successors(s, d), _root(s, d))


def _hits_top(column: str):
    def query(s: SparkSession, d: str) -> DataFrame:
        e = supplies(s, d)
        return gr.top_by(gr.hits(e, 3), column, e)

    return query


def _pagerank_top(s: SparkSession, d: str) -> DataFrame:
    e = supplies(s, d)
    return gr.top_by(gr.pagerank(e, STEPS), "pr", e)


def _link_lists(s: SparkSession, d: str) -> DataFrame:
    lists = gr.link_lists(successors(s, d), LINK_BLOCK)
    return lists.select("id", "block", F.concat_ws(",", "in_links").alias("in_links"), F.concat_ws(",", "out_links").alias("out_links"))


def _edge_union(s: SparkSession, d: str) -> DataFrame:
    text = lambda e: e.select(F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst"))
    return text(supplies(s, d)).union(text(successors(s, d))).distinct()


def _frontier_except(s: SparkSession, d: str) -> DataFrame:
    """Parts linked from the root set that are not in it."""
    e, root = successors(s, d), _root(s, d)
    return e.join(root.select(F.col("id").alias("src")), "src", "left_semi").select(F.col("dst").alias("id")).distinct().join(root, "id", "left_anti")


QUERIES = {
    "degrees": lambda s, d: gr.degrees(supplies(s, d)),
    "sink_nodes": lambda s, d: gr.sinks(supplies(s, d)),
    "edge_union": _edge_union,
    "pagerank_k": lambda s, d: _rounded(gr.pagerank(successors(s, d), STEPS)),
    "pagerank_sinks_k": lambda s, d: _rounded(gr.pagerank(supplies(s, d), STEPS)),
    "pagerank_top": _pagerank_top,
    "pagerank_converged": lambda s, d: _rounded(gr.pagerank(successors(s, d))),
    "hits_k": lambda s, d: _rounded(gr.hits(supplies(s, d), 3)),
    "hits_converged": lambda s, d: _rounded(gr.hits(supplies(s, d), tolerance=1e-9), 9),
    "pagerank_sum": lambda s, d: gr.pagerank(successors(s, d), STEPS).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("pr"), 9).alias("total")),
    "base_set_grown": lambda s, d: gr.grown_base_set(successors(s, d), s.createDataFrame([(1,), (2,)], "id long"), 10**9),
    "hits_top_auth": _hits_top("auth"),
    "hits_top_hub": _hits_top("hub"),
    "base_set": _base,
    "induced_subgraph": lambda s, d: gr.induced(successors(s, d), _base(s, d)),
    "base_set_200": _base_200,
    "induced_subgraph_200": lambda s, d: gr.induced(successors(s, d), _base_200(s, d)),
    "bfs_depth": lambda s, d: gr.bfs(successors(s, d), s.createDataFrame([(1,)], "id long"), 3),
    "link_lists": _link_lists,
    "frontier_except": _frontier_except,
    "edges_without": lambda s, d: gr.without_vertices(successors(s, d), _root(s, d)),
}

_TOP = "select row_number() over (order by score desc, id) rank, id, score, in_degree, out_degree from (select id, round({c}, 12) score from {t}) join deg using (id) order by score desc, id limit 500"
_ROOT = f"root as (select p_partkey id from part where p_size = {ROOT_SIZE})"
_BASE = f"{SUCCESSOR}, {_ROOT}, ins as (select src, row_number() over (partition by dst order by md5(src::varchar), src) r from edges where dst in (select id from root)), base as (select id from root union select dst from edges where src in (select id from root) union select src from ins where r <= 5)"
_BASE_200 = _BASE.replace("r <= 5", "r <= 200")

ORACLES = {
    "degrees": f"with {BIPARTITE}, {DEGREES} select * from deg",
    "sink_nodes": f"with {BIPARTITE}, {DEGREES} select id from deg where out_degree = 0",
    "edge_union": f"with {BIPARTITE}, b as (select * from edges), f as (with {SUCCESSOR} select * from edges) select src, dst from b union select src::varchar, dst::varchar from f",
    "pagerank_k": f"with {SUCCESSOR}, {DEGREES}, {pagerank(STEPS)} select id, round(pr, 12) pr from p{STEPS}",
    "pagerank_sinks_k": f"with {BIPARTITE}, {DEGREES}, {pagerank(STEPS)} select id, round(pr, 12) pr from p{STEPS}",
    "pagerank_top": f"with {BIPARTITE}, {DEGREES}, {pagerank(STEPS)} " + _TOP.format(c="pr", t=f"p{STEPS}"),
    "hits_k": f"with {BIPARTITE}, {DEGREES}, {hits(3)} select id, round(auth, 12) auth, round(hub, 12) hub from h3",
    "hits_top_auth": f"with {BIPARTITE}, {DEGREES}, {hits(3)} " + _TOP.format(c="auth", t="h3"),
    "hits_top_hub": f"with {BIPARTITE}, {DEGREES}, {hits(3)} " + _TOP.format(c="hub", t="h3"),
    "base_set": f"with {_BASE} select id from base",
    "induced_subgraph": f"with {_BASE} select src, dst from edges where src in (select id from base) and dst in (select id from base)",
    "base_set_200": f"with {_BASE_200} select id from base",
    "induced_subgraph_200": f"with {_BASE_200} select src, dst from edges where src in (select id from base) and dst in (select id from base)",
    "bfs_depth": f"with {SUCCESSOR}, d0 as (select 1::bigint id, 0 depth), d1 as (select distinct dst id, 1 depth from edges join d0 on id = src where dst not in (select id from d0)), s1 as (select * from d0 union all select * from d1), d2 as (select distinct dst id, 2 depth from edges join d1 on id = src where dst not in (select id from s1)), s2 as (select * from s1 union all select * from d2), d3 as (select distinct dst id, 3 depth from edges join d2 on id = src where dst not in (select id from s2)) select * from s2 union all select * from d3",
    "link_lists": f"with {SUCCESSOR}, x as (select dst id, 'i' s, src o from edges union all select src, 'o', dst from edges), y as (select *, (row_number() over (partition by id, s order by o) - 1) // {LINK_BLOCK} block from x) select id, block::bigint as block, coalesce(string_agg(o::varchar, ',' order by o) filter (s = 'i'), '') in_links, coalesce(string_agg(o::varchar, ',' order by o) filter (s = 'o'), '') out_links from y group by all",
    "pagerank_sum": f"with {SUCCESSOR}, {DEGREES}, {pagerank(STEPS)} select count(*) n, round(sum(pr), 9) total from p{STEPS}",
    "hits_converged": f"with {BIPARTITE}, {DEGREES}, {hits(40)} select id, round(auth, 9) auth, round(hub, 9) hub from h40",
    "base_set_grown": f"with recursive {SUCCESSOR}, both_ as (select src a, dst b from edges union select dst, src from edges), r(id) as (select unnest([1, 2])::bigint union select b from r join both_ on a = id) select id from r",
    "frontier_except": f"with {SUCCESSOR}, {_ROOT} select dst id from edges where src in (select id from root) except select id from root",
    "edges_without": f"with {SUCCESSOR}, {_ROOT} select src, dst from edges where src not in (select id from root) and dst not in (select id from root)",
}
