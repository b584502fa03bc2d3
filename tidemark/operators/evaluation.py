"""Evaluation of ranked runs against relevance grades."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Fixed values of the evaluators.
CUTOFFS = (5, 10, 20, 50, 100)
CUTOFFS_WIDE = (5, 10, 15, 20, 30, 100, 200, 500, 1000)
LEVELS = tuple(x / 10 for x in range(11))
RELEVANT = 1.0


def _upto():
    """Window over the ranks of a query up to the current one."""
    return Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)


def _onward():
    return Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.currentRow, Window.unboundedFollowing)


def summed_grades(qrels: DataFrame) -> DataFrame:
    """(query_id, doc_id, grade): grades of one document added up; null grades count 0."""
    return qrels.groupBy("query_id", "doc_id").agg(F.sum(F.coalesce("grade", F.lit(0.0))).alias("grade"))


def majority_grades(qrels: DataFrame) -> DataFrame:
    """(query_id, doc_id, grade): the grade most assessors gave, ties by the lower one; 1 if it has one vote only."""
    votes = qrels.filter("grade is not null").groupBy("query_id", "doc_id", "grade").agg(F.count(F.lit(1)).alias("votes"))
    best = votes.groupBy("query_id", "doc_id").agg(F.max(F.struct("votes", (-F.col("grade")).alias("g"))).alias("b"))
    return best.select("query_id", "doc_id", F.when(F.col("b.votes") == 1, 1.0).otherwise(-F.col("b.g")).alias("grade"))


def relevant_counts(grades: DataFrame) -> DataFrame:
    """(query_id, n_rel): relevant documents of each judged query."""
    return grades.groupBy("query_id").agg(F.count_if(F.col("grade") >= RELEVANT).alias("n_rel"))


def judged(run: DataFrame, grades: DataFrame) -> DataFrame:
    """The run of judged queries with grade (0 if unjudged), rel, num_rel, n_rel, precision, recall at each rank."""
    met = run.join(relevant_counts(grades), "query_id").join(grades.select("query_id", "doc_id", "grade"), ["query_id", "doc_id"], "left")
    met = met.withColumn("grade", F.coalesce("grade", F.lit(0.0))).withColumn("rel", (F.col("grade") >= RELEVANT).cast("int"))
    met = met.withColumn("num_rel", F.sum("rel").over(_upto()))
    return met.withColumn("precision", F.col("num_rel") / F.col("rank")).withColumn("recall", F.col("num_rel") / F.nullif("n_rel", F.lit(0)))


def average_precision(j: DataFrame) -> DataFrame:
    """(query_id, ap); 0 for queries without relevant documents."""
    return j.groupBy("query_id").agg((F.sum(F.col("rel") * F.col("precision")) / F.nullif(F.first("n_rel"), F.lit(0))).alias("ap")).select("query_id", F.coalesce("ap", F.lit(0.0)).alias("ap"))


def graded_average_precision(run: DataFrame, grades: DataFrame) -> DataFrame:
    """(query_id, ap): sum of grade (1 + grades so far) / rank over the sum of all grades."""
    whole = grades.groupBy("query_id").agg(F.sum("grade").alias("n_rel")).filter("n_rel > 0")
    met = run.join(whole, "query_id").join(grades, ["query_id", "doc_id"], "left").withColumn("grade", F.coalesce("grade", F.lit(0.0)))
    met = met.withColumn("so_far", F.sum("grade").over(_upto()) - F.col("grade"))
    return met.groupBy("query_id").agg((F.sum(F.col("grade") * (1 + F.col("so_far")) / F.col("rank")) / F.first("n_rel")).alias("ap"))


def at_cutoffs(j: DataFrame, cutoffs: Sequence[int] = CUTOFFS, beyond: str = "pad") -> DataFrame:
    """(query_id, k, precision, recall, f1). Past the run's end: ``skip`` no row, ``zero`` zeros, ``pad`` relevant retrieved / k."""
    ends = j.groupBy("query_id").agg(F.max("rank").alias("n_ret"), F.sum("rel").alias("rel_ret"), F.first("n_rel").alias("n_rel"), F.map_from_entries(F.collect_list(F.when(F.col("rank").isin(*cutoffs), F.struct("rank", "num_rel")))).alias("at"))
    out = ends.select("*", F.explode(F.array(*(F.lit(k).cast("long") for k in cutoffs))).alias("k"))
    past = F.col("k") > F.col("n_ret")
    if beyond == "skip":
        out = out.filter(~past)
    hits = F.when(past, F.lit(0) if beyond == "zero" else F.col("rel_ret")).otherwise(F.try_element_at("at", F.col("k")))
    out = out.withColumn("p", hits / F.col("k")).withColumn("r", F.coalesce(hits / F.nullif("n_rel", F.lit(0)), F.lit(0.0)))
    f1 = F.when(F.col("p") + F.col("r") > 0, 2 * F.col("p") * F.col("r") / (F.col("p") + F.col("r"))).otherwise(0.0)
    return out.select("query_id", "k", F.col("p").alias("precision"), F.col("r").alias("recall"), f1.alias("f1"))


def r_precision(j: DataFrame) -> DataFrame:
    """(query_id, rprec): precision at rank R; relevant retrieved / R for shorter runs."""
    at = F.max(F.when(F.col("rank") == F.col("n_rel"), F.col("num_rel")))
    return j.filter("n_rel > 0").groupBy("query_id").agg((F.coalesce(at, F.sum("rel")) / F.first("n_rel")).alias("rprec"))


def r_precision_equal(j: DataFrame) -> DataFrame:
    """(query_id, rprec): the last precision that equals the recall and is not 0, else 0."""
    met = F.when((F.col("num_rel") > 0) & (F.col("rank") == F.col("n_rel")), F.col("precision"))
    return j.filter("n_rel > 0").groupBy("query_id").agg(F.coalesce(F.max(met), F.lit(0.0)).alias("rprec"))


def r_precision_graded(j: DataFrame, grades: DataFrame) -> DataFrame:
    """(query_id, rprec) where R is the sum of a query's grades: between two ranks for a broken R, and hits over R for runs shorter than R."""
    whole = grades.groupBy("query_id").agg(F.sum("grade").alias("r")).filter("r > 0")
    met = j.join(whole, "query_id").withColumn("low", F.floor("r"))
    at = lambda rank: F.coalesce(F.max(F.when(F.col("rank") == rank, F.col("precision"))), F.lit(0.0))
    ends = met.groupBy("query_id").agg(F.max("r").alias("r"), F.max("rank").alias("n"), F.sum("rel").alias("hits"), at(F.col("low")).alias("p"), at(F.col("low") + 1).alias("q"))
    part = F.col("r") - F.floor("r")
    return ends.select("query_id", F.when(F.col("r") > F.col("n"), F.col("hits") / F.col("r")).otherwise((1 - part) * F.col("p") + part * F.col("q")).alias("rprec"))


def accuracy(rows: DataFrame, probability: str, truth: str, tie: int = 1) -> DataFrame:
    """One row (n, accuracy) of the likelier of two classes against the truth; a probability of one half gives class ``tie``. Null probabilities and truths are left out."""
    p = F.col(probability)
    told = F.when(p == 0.5, F.lit(tie)).otherwise((p > 0.5).cast("int"))
    return rows.filter(p.isNotNull() & F.col(truth).isNotNull()).agg(F.count(F.lit(1)).alias("n"), F.avg((told == F.col(truth)).cast("double")).alias("accuracy"))


def with_assessments(hits: DataFrame, assessments: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``hits`` with the ``grade`` that an assessor gave, null where none did; the assessments are unique by ``keys``."""
    return hits.join(assessments.select(*keys, "grade"), list(keys), "left")


def _gain(rank: str) -> Column:
    return F.when(F.col(rank) == 1, F.col("grade")).otherwise(F.col("grade") / F.log2(rank))


def ndcg(run: DataFrame, grades: DataFrame, ideal: str = "judged") -> DataFrame:
    """(query_id, ndcg), the first rank undiscounted.

    ``ideal``: ``judged`` all judged documents in their listed order (column ``pos``); ``retrieved``
    the run's grades from the highest; 0 where the ideal is 0.
    """
    met = run.join(grades.select("query_id", "doc_id", "grade"), ["query_id", "doc_id"], "left").withColumn("grade", F.coalesce("grade", F.lit(0.0)))
    got = met.groupBy("query_id").agg(F.sum(_gain("rank")).alias("dcg"))
    if ideal == "retrieved":
        best = met.withColumn("i", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("grade"), "rank")))
    else:
        best = grades.withColumn("i", F.row_number().over(Window.partitionBy("query_id").orderBy("pos", "doc_id")))
    best = best.groupBy("query_id").agg(F.sum(_gain("i")).alias("idcg"))
    return got.join(best, "query_id").select("query_id", F.coalesce(F.col("dcg") / F.nullif("idcg", F.lit(0.0)), F.lit(0.0)).alias("ndcg"))


def interpolated(j: DataFrame, levels: Sequence[float] = LEVELS) -> DataFrame:
    """(query_id, level, precision): the highest precision at or after the first rank of that recall, else 0."""
    best = j.filter("n_rel > 0").withColumn("best", F.max("precision").over(_onward()))
    reached = [F.coalesce(F.max(F.when(F.col("recall") >= x, F.col("best"))), F.lit(0.0)) for x in levels]
    wide = best.groupBy("query_id").agg(F.array(*reached).alias("ps"))
    return wide.select("query_id", F.posexplode("ps").alias("i", "precision")).select("query_id", (F.col("i") / 10).alias("level"), "precision")


def precision_recall_curve(j: DataFrame, start: bool = False) -> DataFrame:
    """(query_id, rank, recall, precision, monotone): ranks where recall grows, with the running least precision.

    With ``start`` each curve begins at rank 0 with recall 0 and precision 1.
    """
    met = j.filter("rel = 1 and n_rel > 0")
    if start:
        met = met.select("query_id", "rank", "recall", "precision")
        met = met.unionByName(j.filter("n_rel > 0").select("query_id", F.lit(0).cast("long").alias("rank"), F.lit(0.0).alias("recall"), F.lit(1.0).alias("precision")).distinct())
    return met.select("query_id", "rank", "recall", "precision", F.min("precision").over(_upto()).alias("monotone"))


def summary(j: DataFrame, run: DataFrame) -> DataFrame:
    """One row: queries, retrieved, relevant, relevant retrieved, MAP over all queries of the run and over those with relevant documents."""
    per = j.groupBy("query_id").agg(F.count(F.lit(1)).alias("ret"), F.first("n_rel").alias("n_rel"), F.sum("rel").alias("rel_ret"), F.sum(F.col("rel") * F.col("precision")).alias("sp")).filter("n_rel > 0")
    sums = per.agg(F.count(F.lit(1)).alias("n_relevant_queries"), F.sum("ret").alias("retrieved"), F.sum("n_rel").alias("relevant"), F.sum("rel_ret").alias("relevant_retrieved"), F.sum(F.col("sp") / F.col("n_rel")).alias("s"))
    queries = run.agg(F.countDistinct("query_id").alias("n_queries"))
    return sums.crossJoin(queries).select("n_queries", "n_relevant_queries", "retrieved", "relevant", "relevant_retrieved", (F.col("s") / F.col("n_queries")).alias("map_all"), (F.col("s") / F.col("n_relevant_queries")).alias("map_relevant"))  # one row each


def pair_counts(rows: DataFrame, query: str, cluster: str) -> DataFrame:
    """One row of same/other query x same/other cluster pair counts, self pairs included, and the accuracy.

    From the group sizes alone: n (n + 1) / 2 pairs lie within a group of n.
    """
    pairs = lambda cols: rows.groupBy(*cols).agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum(F.expr("n * (n + 1) div 2")), F.lit(0)).alias("p"))
    one = pairs([query, cluster]).select(F.col("p").alias("both")).crossJoin(pairs([query]).select(F.col("p").alias("q"))).crossJoin(pairs([cluster]).select(F.col("p").alias("c"))).crossJoin(rows.agg(F.expr("count(*) * (count(*) + 1) div 2").alias("a")))  # one row each
    out = one.select(F.col("both").alias("same_both"), (F.col("q") - F.col("both")).alias("same_query"), (F.col("c") - F.col("both")).alias("same_cluster"), (F.col("a") - F.col("q") - F.col("c") + F.col("both")).alias("neither"), "a")
    return out.select("same_both", "same_query", "same_cluster", "neither", ((F.col("same_both") + F.col("neither")) / F.col("a")).alias("accuracy"))
