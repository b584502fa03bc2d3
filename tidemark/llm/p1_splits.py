"""Problem 1: splits that keep related records together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.components import MERGE_ROWS, components
from tidemark.session import materialize

#: White space of any script, and the marks that take no room.
SPACE = r"[\s\p{Z}\x{0085}\x{200B}\x{FEFF}]+"


def clean_id(col: str) -> Column:
    """An identifier free of white space, in upper case; blank ones are null."""
    return F.nullif(F.upper(F.regexp_replace(F.col(col), SPACE, "")), F.lit(""))


def _vertices(rows: DataFrame, query: str, doc: str, row: str) -> DataFrame:
    """(vertex, doc): a row without query stands under its doc_id, without both under its own id.

    The stand-ins lie below -2**62, where no query_id is; a hash collision could only tie more.
    """
    stand_in = F.concat_ws("|", F.coalesce(F.concat(F.lit("d"), F.col("_doc")), F.concat(F.lit("r"), F.col(row).cast("string"))))
    low = F.lit(-(2**62)) - F.pmod(F.xxhash64(stand_in), F.lit(2**61))
    return rows.withColumn("_doc", clean_id(doc)).withColumn("_vertex", F.coalesce(F.col(query).cast("long"), low))


def _ties(marked: DataFrame) -> DataFrame:
    """Edges vertex - smallest vertex that holds the same doc; docs of one vertex give none."""
    pairs = marked.filter("_doc is not null").select("_doc", "_vertex")
    shared = pairs.groupBy("_doc").agg(F.min("_vertex").alias("b"), F.max("_vertex").alias("_most")).filter("b < _most").drop("_most")
    return pairs.join(shared, "_doc").filter("_vertex != b").select(F.col("_vertex").alias("a"), "b")


def related_queries(rows: DataFrame, query: str = "query_id", doc: str = "doc_id", row: str = "row_id", merge_rows: int = MERGE_ROWS) -> DataFrame:
    """(vertex, component) of the vertices tied through doc_ids; see :func:`components`."""
    return components(_ties(_vertices(rows, query, doc, row)), merge_rows)


def greedy_runs(sizes: list[tuple[int, int]], shares: list[tuple[str, float]]) -> list[tuple[int, list[int]]]:
    """Largest first, each group to the split furthest below its target.

    ``sizes``: (rows of a group, number of such groups). Of the equal groups of a size, split j
    takes as many as its shortfalls d, d - s, d - 2s, ... are among the largest of all splits;
    that is what one group after another comes to. Ties go to the split named first.
    """
    total = sum(s * c for s, c in sizes)
    whole = sum(max(0.0, x or 0.0) for _, x in shares) or 1.0
    short = [max(0.0, x or 0.0) / whole * total for _, x in shares]
    out = []
    for size, count in sorted(sizes, reverse=True):
        taken = [0] * len(short)
        if count > 64:  # what lies surely above the common level is taken at once
            low, high = min(short) - size * count, max(short)
            for _ in range(100):
                level = (low + high) / 2
                if sum(max(0, (d - level) // size + 1) for d in short if d > level) > count - 2 * len(short):
                    low = level
                else:
                    high = level
            taken = [int(max(0, (d - high) // size + 1)) if d > high else 0 for d in short]
            if sum(taken) > count:
                taken = [0] * len(short)
        short = [d - size * n for d, n in zip(short, taken)]
        for _ in range(count - sum(taken)):
            j = max(range(len(short)), key=lambda i: (short[i], -i))
            taken[j] += 1
            short[j] -= size
        out.append((size, taken))
    return out


def grouped_splits(rows: DataFrame, targets: DataFrame, query: str = "query_id", doc: str = "doc_id", row: str = "row_id", merge_rows: int = MERGE_ROWS) -> DataFrame:
    """``rows`` with ``group_id`` and ``split``.

    Rows that share a query or a document (white space and case of ``doc`` ignored), directly or
    through others, get one group and one split. Null ids tie nothing; a row without query goes
    with its document, one without both is a group. Repeated rows stay, in one split. Null or
    negative target shares count as 0; no targets give a null split; no rows give none. Other
    columns are kept; existing ``group_id`` and ``split`` columns are replaced.

    The groups' sizes reach the driver only as a histogram, whose length is at most the square
    root of twice the number of rows; the targets are a small table by definition.
    """
    spark = rows.sparkSession
    marked = _vertices(rows.drop("group_id", "split"), query, doc, row)
    label = components(_ties(marked), merge_rows).select(F.col("vertex").alias("_vertex"), F.col("component").alias("_component"))
    per_vertex = marked.groupBy("_vertex").agg(F.count(F.lit(1)).alias("n"))
    member = per_vertex.join(label, "_vertex", "left").withColumn("group_id", F.coalesce("_component", "_vertex")).drop("_component")
    member = materialize(member)
    sizes = member.groupBy("group_id").agg(F.sum("n").alias("size"))
    # Rank among the groups of equal size: within hashed buckets, then by the buckets' counts.
    buckets = 1 + per_vertex.sparkSession.sparkContext.defaultParallelism
    sizes = sizes.withColumn("bucket", F.pmod(F.xxhash64("group_id"), F.lit(buckets)).cast("int"))
    counts = materialize(sizes.groupBy("size", "bucket").agg(F.count(F.lit(1)).alias("c")))
    hist = [(r[0], r[1]) for r in counts.groupBy("size").agg(F.sum("c")).collect()]
    shares = sorted((r[0], r[1]) for r in targets.select("split_name", "target_share").filter("split_name is not null").distinct().collect())
    shares = sorted(shares, key=lambda x: (-(x[1] or 0), x[0]))
    runs = [(size, name, sum(taken[:j]), sum(taken[: j + 1])) for size, taken in greedy_runs(hist, shares) for j, (name, _) in enumerate(shares) if taken[j]] if shares else []
    plan = spark.createDataFrame(runs, "size long, split string, lo long, hi long")
    before = counts.withColumn("before", F.sum("c").over(Window.partitionBy("size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)))
    place = F.row_number().over(Window.partitionBy("size", "bucket").orderBy("group_id")) - 1
    ranked = sizes.withColumn("place", place).join(before.select("size", "bucket", F.coalesce("before", F.lit(0)).alias("before")), ["size", "bucket"])
    ranked = ranked.withColumn("place", F.col("place") + F.col("before"))
    chosen = ranked.join(plan, "size", "left").filter("split is null or (place >= lo and place < hi)").select("group_id", "split")
    of_vertex = member.select("_vertex", "group_id").join(chosen, "group_id")
    return marked.join(of_vertex, "_vertex").drop("_vertex", "_doc")


def split_shares(assigned: DataFrame, targets: DataFrame) -> DataFrame:
    """(split, target_share, rows, actual_share): what each split of the small target table was to have and has; no rows give shares of 0."""
    n = assigned.groupBy(F.col("split").alias("_s")).agg(F.count(F.lit(1)).alias("rows"))
    whole = assigned.agg(F.count(F.lit(1)).alias("_all"))
    asked = targets.filter("split_name is not null").groupBy(F.col("split_name").alias("split")).agg(F.max("target_share").alias("target_share"))
    got = asked.join(n, F.col("split") == F.col("_s"), "left").crossJoin(F.broadcast(whole))  # one row
    rows = F.coalesce("rows", F.lit(0).cast("long"))
    return got.select("split", "target_share", rows.alias("rows"), F.coalesce(rows / F.nullif("_all", F.lit(0)), F.lit(0.0)).alias("actual_share"))
