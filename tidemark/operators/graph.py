"""Link analysis over edges(src, dst)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators.order import placed
from tidemark.session import drop_materialized, materialize

DAMPING = 0.85
#: Links of one side that a row of :func:`link_lists` holds.
LINK_BLOCK = 10_000
#: Steps of an iteration between two written tables.
CUT_EVERY = 4


def distinct_edges(edges: DataFrame, loops: bool = False) -> DataFrame:
    """Set semantics; null ends dropped; self-loops dropped unless ``loops``."""
    kept = edges.select("src", "dst").filter("src is not null and dst is not null")
    return (kept if loops else kept.filter("src != dst")).distinct()


def vertices(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("id")).union(edges.select(F.col("dst").alias("id"))).distinct()


def degrees(edges: DataFrame) -> DataFrame:
    """(id, in_degree, out_degree) in one shuffle."""
    ends = edges.select(F.col("src").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")).unionByName(edges.select(F.col("dst").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")))
    return ends.groupBy("id").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))


def sinks(edges: DataFrame) -> DataFrame:
    return degrees(edges).filter("out_degree = 0").select("id")


def _pagerank_step(state: DataFrame, links: DataFrame, damping: float) -> DataFrame:
    """state: (id, out_degree, pr); the sink mass and N come from one aggregate of one row."""
    given = links.join(state.select(F.col("id").alias("src"), (F.col("pr") / F.nullif("out_degree", F.lit(0))).alias("share")), "src").groupBy(F.col("dst").alias("id")).agg(F.sum("share").alias("x"))
    whole = state.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.when(F.col("out_degree") == 0, F.col("pr"))), F.lit(0.0)).alias("sink"))
    new = (1 - damping) / F.col("n") + damping * F.col("sink") / F.col("n") + damping * F.coalesce("x", F.lit(0.0))
    return state.join(given, "id", "left").crossJoin(F.broadcast(whole)).select("id", "out_degree", new.alias("pr"))  # one row


def pagerank(edges: DataFrame, steps: int | None = None, tolerance: float = 1e-9, damping: float = DAMPING, most_steps: int = 200) -> DataFrame:
    """(id, pr) after ``steps`` updates, or once no rank moves by more than ``tolerance``.

    Edges count once; self-loops are left out; an empty graph gives no rows. Lineage is cut by
    written tables every few steps.
    """
    links = materialize(distinct_edges(edges))
    state = degrees(links).select("id", "out_degree")
    n = state.agg(F.count(F.lit(1)).alias("n"))
    state = materialize(state.crossJoin(F.broadcast(n)).select("id", "out_degree", (1 / F.col("n")).alias("pr")))  # one row
    for i in range(1, (most_steps if steps is None else steps) + 1):
        new = _pagerank_step(state, links, damping)
        if steps is None or i % CUT_EVERY == 0:
            new = materialize(new)
            if steps is None:
                moved = new.join(state.select("id", F.col("pr").alias("old")), "id").agg(F.max(F.abs(F.col("pr") - F.col("old")))).first()[0]
                drop_materialized(state)
                if moved is None or moved <= tolerance:
                    return new.select("id", "pr")
        state = new
    return state.select("id", "pr")


def hits(edges: DataFrame, steps: int = 200, tolerance: float | None = None) -> DataFrame:
    """(id, auth, hub) after ``steps`` simultaneous updates from 1, each vector at L2 norm 1.

    With ``tolerance`` the updates end once no value moves by more than that.
    """
    links = materialize(distinct_edges(edges))
    state = vertices(links).select("id", F.lit(1.0).alias("auth"), F.lit(1.0).alias("hub"))
    before = state
    for i in range(1, steps + 1):
        auth = links.join(state.select(F.col("id").alias("src"), "hub"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum("hub").alias("a"))
        hub = links.join(state.select(F.col("id").alias("dst"), "auth"), "dst").groupBy(F.col("src").alias("id")).agg(F.sum("auth").alias("h"))
        raw = state.select("id").join(auth, "id", "left").join(hub, "id", "left").select("id", F.coalesce("a", F.lit(0.0)).alias("a"), F.coalesce("h", F.lit(0.0)).alias("h"))
        norm = raw.agg(F.sqrt(F.sum(F.col("a") * F.col("a"))).alias("na"), F.sqrt(F.sum(F.col("h") * F.col("h"))).alias("nh"))
        state = raw.crossJoin(F.broadcast(norm)).select("id", (F.col("a") / F.nullif("na", F.lit(0.0))).alias("auth"), (F.col("h") / F.nullif("nh", F.lit(0.0))).alias("hub"))  # one row
        if i % 2 == 0 and i < steps:
            old, state = before, materialize(state)
            if tolerance is not None:
                far = state.join(old.select("id", F.col("auth").alias("a0"), F.col("hub").alias("h0")), "id").agg(F.max(F.greatest(F.abs(F.col("auth") - F.col("a0")), F.abs(F.col("hub") - F.col("h0"))))).first()[0]
                if far is None or far <= tolerance:
                    break
            before = state
    return state


def top_by(scores: DataFrame, score: str, edges: DataFrame, k: int = 500) -> DataFrame:
    """(rank, id, score, in_degree, out_degree) of the first ``k`` by rounded score, then id."""
    full = scores.select("id", F.round(score, 12).alias("score")).join(degrees(distinct_edges(edges)), "id")
    first = full.orderBy(F.desc("score"), "id").limit(k)
    return first.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "id")).cast("long")).select("rank", "id", "score", "in_degree", "out_degree")  # k rows


def base_set(edges: DataFrame, root: DataFrame, most_in: int = 200) -> DataFrame:
    """(id): root, its out-neighbours, and for each of its members at most ``most_in`` in-neighbours, chosen by hash."""
    links = distinct_edges(edges)
    out = links.join(root.select(F.col("id").alias("src")), "src", "left_semi").select(F.col("dst").alias("id"))
    into = links.join(root.select(F.col("id").alias("dst")), "dst", "left_semi")
    pick = F.row_number().over(Window.partitionBy("dst").orderBy(F.md5(F.col("src").cast("string")), "src"))
    into = into.withColumn("r", pick).filter(F.col("r") <= most_in).select(F.col("src").alias("id"))
    return root.select("id").union(out).union(into).distinct()


def grown_base_set(edges: DataFrame, root: DataFrame, size: int = 10_000, most_in: int = 200) -> DataFrame:
    """(id): base sets of base sets of ``root`` until ``size`` vertices are reached or no more are linked."""
    links = materialize(distinct_edges(edges))
    now = materialize(root.select("id").distinct())
    n = now.count()
    while n < size:
        more = materialize(base_set(links, now, most_in))
        drop_materialized(now)
        now, reached = more, more.count()
        if reached == n:
            break
        n = reached
    return now


def induced(edges: DataFrame, keep: DataFrame) -> DataFrame:
    """Edges with both ends in ``keep`` (id)."""
    links = distinct_edges(edges)
    return links.join(keep.select(F.col("id").alias("src")), "src", "left_semi").join(keep.select(F.col("id").alias("dst")), "dst", "left_semi").select("src", "dst")


def link_lists(edges: DataFrame, block: int = LINK_BLOCK) -> DataFrame:
    """(id, block, in_links, out_links), sorted, at most ``block`` of either in a row; a vertex without any has an empty list.

    A hub that a third of all pages link to has many blocks, and no row or task holds all of them.
    """
    links = materialize(distinct_edges(edges))
    ends = links.select(F.col("dst").alias("id"), F.lit("i").alias("side"), F.col("src").alias("other")).unionByName(links.select(F.col("src").alias("id"), F.lit("o").alias("side"), F.col("dst").alias("other")))
    spread = placed(ends, ["id", "side"], [F.col("other")])
    blocks = spread.withColumn("block", F.floor((F.col("place") - 1) / block).cast("long"))
    pick = lambda side: F.sort_array(F.collect_list(F.when(F.col("side") == side, F.col("other"))))
    return blocks.groupBy("id", "block").agg(pick("i").alias("in_links"), pick("o").alias("out_links"))  # block entries of either side at most


def bfs(edges: DataFrame, seeds: DataFrame, most_depth: int | None = None) -> DataFrame:
    """(id, depth) by waves from ``seeds``; vertices never reached are left out."""
    links = materialize(distinct_edges(edges))
    seen = materialize(seeds.select("id").distinct().withColumn("depth", F.lit(0)))
    depth = 0
    while most_depth is None or depth < most_depth:
        wave = seen.filter(F.col("depth") == depth).select(F.col("id").alias("src"))
        new = links.join(wave, "src", "left_semi").select(F.col("dst").alias("id")).distinct().join(seen, "id", "left_anti")
        new = materialize(new.withColumn("depth", F.lit(depth + 1)))
        if new.isEmpty():
            break
        seen = seen.unionByName(new)
        depth += 1
        if depth % CUT_EVERY == 0:
            seen = materialize(seen)
    return seen


def without_vertices(edges: DataFrame, drop: DataFrame) -> DataFrame:
    """Edges that touch none of ``drop`` (id)."""
    return edges.join(drop.select(F.col("id").alias("src")), "src", "left_anti").join(drop.select(F.col("id").alias("dst")), "dst", "left_anti").select("src", "dst")
