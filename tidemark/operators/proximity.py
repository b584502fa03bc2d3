"""How near the terms of a query stand in a document."""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators.index import Index
from tidemark.operators.ranking import parts_of
from tidemark.session import materialize, ship_package

# Fixed value of the model.
REACH = 1500


def minimal_span(lists: list[list[int]]) -> int:
    """Least distance between the first and last of one position from each rising list."""
    heads = [(positions[0], i, 0) for i, positions in enumerate(lists)]
    heapq.heapify(heads)
    last = max(h[0] for h in heads)
    best = last - heads[0][0]
    while True:
        first, i, k = heads[0]
        best = min(best, last - first)
        if k + 1 == len(lists[i]):
            return best
        last = max(last, lists[i][k + 1])
        heapq.heapreplace(heads, (lists[i][k + 1], i, k + 1))


def greedy_span(lists: list[list[int]]) -> int:
    """The least span met by advancing one list after another in turn while a list can advance; not always the minimum."""
    at = [0] * len(lists)
    span = lambda: max(p[k] for p, k in zip(lists, at)) - min(p[k] for p, k in zip(lists, at))
    best = span()
    while any(k + 1 < len(p) for p, k in zip(lists, at)):
        for i, p in enumerate(lists):
            if at[i] + 1 < len(p):
                at[i] += 1
                best = min(best, span())
    return best


def occurrences(tokens_: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, doc_id, term, pos) where tokens (doc_id, pos, term) are terms of a query; others are dropped before the shuffle."""
    return tokens_.join(queries.select("query_id", "term").distinct(), "term").select("query_id", "doc_id", "term", "pos")


def spans(tokens_: DataFrame, queries: DataFrame, greedy: bool = False) -> DataFrame:
    """(query_id, doc_id, n_met, span) where at least two different query terms occur.

    The minimum is found at one of the occurrences: there, the span reaches back to the earliest
    of the last positions so far of all terms met. These are running maxima, one for each term
    place of the longest query, over one sort of a document's occurrences.
    """
    if greedy:
        return _greedy_spans(occurrences(tokens_, queries))
    words = queries.select("query_id", "term").distinct()
    numbered = materialize(words.withColumn("k", F.row_number().over(Window.partitionBy("query_id").orderBy("term"))))
    most = numbered.agg(F.max("k")).first()[0] or 0
    # The query terms' tokens are few and are dealt out by document; met with the queries they need no shuffle.
    asked = tokens_.join(words.select("term").distinct(), "term", "left_semi")
    met = asked.repartition(parts_of(tokens_), "doc_id").join(numbered, "term").select("query_id", "doc_id", "pos", "k")
    upto = Window.partitionBy("query_id", "doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = met.withColumns({f"l{k}": F.max(F.when(F.col("k") == k, F.col("pos"))).over(upto) for k in range(1, most + 1)})
    back = F.array_compact(F.array(*(F.col(f"l{k}") for k in range(1, most + 1)))) if most else F.array(F.col("pos"))
    wide = last.select("query_id", "doc_id", F.size(back).alias("n"), (F.col("pos") - F.array_min(back)).alias("wide"))
    # Only where all terms of the document have been met is the span one of all of them.
    best = wide.groupBy("query_id", "doc_id").agg(F.min(F.struct((-F.col("n")).alias("n"), "wide")).alias("b")).filter("b.n <= -2")
    return best.select("query_id", "doc_id", (-F.col("b.n")).cast("long").alias("n_met"), F.col("b.wide").cast("long").alias("span"))


def _greedy_spans(met: DataFrame) -> DataFrame:
    ship_package(met.sparkSession)
    lists = met.groupBy("query_id", "doc_id", "term").agg(F.sort_array(F.collect_list("pos")).alias("tp")).groupBy("query_id", "doc_id").agg(F.sort_array(F.collect_list(F.struct("term", "tp"))).alias("l")).filter(F.size("l") >= 2)

    @F.pandas_udf("long")
    def span(column: pd.Series) -> pd.Series:
        return column.map(lambda x: greedy_span([list(p) for p in x]))

    return lists.select("query_id", "doc_id", F.size("l").cast("long").alias("n_met"), span(F.transform("l", lambda x: x["tp"])).alias("span"))


def proximity(index: Index, tokens_: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, doc_id, score) = (1500 - span) |Q| / (dl + V)."""
    sizes = queries.groupBy("query_id").agg(F.sum("qtf").alias("q_len"))
    near = spans(tokens_, queries).join(index.docs, "doc_id").join(materialize(sizes), "query_id").crossJoin(F.broadcast(index.stats()))  # one row
    return near.select("query_id", "doc_id", ((REACH - F.col("span")) * F.col("q_len") / (F.col("dl") + F.col("vocabulary"))).alias("score"))
