"""Problem 8: mixing sources to target weights, by Pareto order sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.session import materialize

#: Sizes are gathered in so many classes for each doubling when inclusion odds are solved for.
FINENESS = 64


def clean_source(col: str) -> Column:
    """Lower case, without blanks around, hyphens and inner blanks as underscores; blank is null."""
    return F.nullif(F.regexp_replace(F.lower(F.regexp_replace(F.col(col), r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")), r"[-\s\p{Z}]+", "_"), F.lit(""))


def feasible_total(available: dict[str, int], targets: dict[str, tuple[float, int]]) -> float:
    """The largest total for which every source that has tokens can give its share within its repeats."""
    live = {s: t for s, t in targets.items() if available.get(s, 0) > 0 and t[0] > 0 and t[1] > 0}
    whole = sum(t[0] for t in live.values())
    return min((available[s] * r / (share / whole) for s, (share, r) in live.items()), default=0.0)


def inclusion_scale(classes: list[tuple[float, int]], wanted: float) -> float:
    """The scale c with sum of min(1, c size) size = wanted over (size, count) classes: odds in proportion to size."""
    if wanted <= 0:
        return 0.0
    low, high = 0.0, 1.0 / min(s for s, _ in classes)
    for _ in range(200):
        c = (low + high) / 2
        if sum(min(1.0, c * s) * s * n for s, n in classes) < wanted:
            low = c
        else:
            high = c
    return high


def mixed_sources(sized: DataFrame, targets: DataFrame, key: str = "doc_id", total: float | None = None, seed: str = "mix") -> tuple[DataFrame, DataFrame]:
    """The documents taken (key, source, n_tokens, copies) and a report of the shares.

    ``sized``: (key, source, n_tokens); ``targets``: (source, target_share, max_repeats).
    Sources are compared in their clean spelling. Without ``total`` the largest total is taken
    at which every source can reach its share without a document exceeding its repeats; with
    one, a source gives at most repeats times its tokens and the report shows what it misses.
    A source gives whole copies of all its documents first, as many as fit; the rest is a sample
    of fixed size in tokens (to half a document) whose inclusion odds grow with a document's
    tokens, by order of odds(random) / odds(inclusion), the random number being a hash of
    ``seed`` and the key.
    A document is a key within a source: rows that repeat both count once, with the most tokens
    given for it; one key in two sources is two documents. Documents of null key, of null or
    unlisted source and without tokens are not taken; null targets count as 0, of targets that
    repeat a source the largest share and repeats hold; an empty table gives no rows. Shares are of the tokens taken, all sources together.

    To the driver come one row for each source of the small target table and the counts by
    size class, at most 64 for each doubling of the largest document.
    """
    spark = sized.sparkSession
    docs = sized.select(F.col(key).alias(key), clean_source("source").alias("source"), F.col("n_tokens").cast("long").alias("n_tokens")).filter(F.col(key).isNotNull() & F.expr("n_tokens > 0 and source is not null"))
    listed = targets.select(clean_source("source").alias("source"), "target_share", "max_repeats").groupBy("source").agg(F.max("target_share"), F.max("max_repeats"))
    wanted = {r[0]: (max(0.0, float(r[1] or 0)), int(r[2] or 0)) for r in sorted(listed.filter("source is not null").collect())}
    docs = materialize(docs.groupBy(key, "source").agg(F.max("n_tokens").alias("n_tokens")))
    size_class = F.floor(F.log2("n_tokens") * FINENESS).cast("int")
    gathered = docs.groupBy("source", size_class.alias("k")).agg(F.sum("n_tokens").alias("t"), F.count(F.lit(1)).alias("c")).collect()
    classes: dict[str, list[tuple[float, int]]] = {}
    available: dict[str, int] = {}
    for source, _, t, c in gathered:
        if source in wanted:
            classes.setdefault(source, []).append((t / c, c))
            available[source] = available.get(source, 0) + t
    if total is None:
        total = feasible_total(available, wanted)
    whole = sum(share for s, (share, r) in wanted.items() if available.get(s, 0) > 0 and r > 0) or 1.0
    plan = []
    for source, (share, repeats) in wanted.items():
        has = available.get(source, 0)
        goal = min(total * share / whole, has * repeats) if has else 0.0
        copies = min(int(goal / has + 1e-12), repeats) if has else 0
        rest = goal - copies * has if has else 0.0
        scale = inclusion_scale(classes[source], rest) if rest > 0.5 and copies < repeats else 0.0
        plan.append((source, share, repeats, copies, scale, rest if scale else 0.0))
    plan_table = F.broadcast(spark.createDataFrame(plan, "source string, target_share double, max_repeats int, whole int, scale double, sample double"))  # a row for each target
    u = (F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), "source", F.col(key).cast("string"))), 1, 12), 16, 10).cast("double") + 0.5) / float(16**12)
    pi = F.col("scale") * F.col("n_tokens")
    order = F.when(pi >= 1, 0.0).otherwise(u / (1 - u) / (pi / (1 - pi)))
    planned = docs.join(plan_table, "source")
    drawn = planned.filter("sample > 0").withColumn("_order", order)
    parts = max(2, spark.sparkContext.defaultParallelism)
    spread = materialize(drawn.select(key, "source", "n_tokens", "_order").repartitionByRange(parts, "source", "_order", key).withColumn("_part", F.spark_partition_id()))
    counts = spread.groupBy("source", "_part").agg(F.sum("n_tokens").alias("n"))
    before = counts.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    upto = F.sum("n_tokens").over(Window.partitionBy("source", "_part").orderBy("_order", key).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    chosen = spread.withColumn("_middle", upto - F.col("n_tokens") / 2).join(before, ["source", "_part"]).join(plan_table.select("source", "sample"), "source")
    chosen = chosen.filter("_middle + before <= sample").select(key, "source", F.lit(1).alias("extra"))
    taken = planned.join(chosen, [key, "source"], "left").withColumn("copies", (F.col("whole") + F.coalesce("extra", F.lit(0))).cast("int")).filter("copies > 0").select(key, "source", "n_tokens", "copies")
    taken = materialize(taken)
    given = taken.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens"), F.count(F.lit(1)).alias("documents"), F.sum("copies").cast("long").alias("copies"), F.max("copies").alias("most_copies"))
    sums = given.agg(F.sum("tokens").alias("all_tokens"))
    report = plan_table.select("source", "target_share", "max_repeats").join(given, "source", "left").crossJoin(F.broadcast(sums))  # one row
    zero = F.lit(0).cast("long")
    report = report.select("source", "target_share", "max_repeats", F.coalesce("tokens", zero).alias("tokens"), F.coalesce(F.col("tokens") / F.col("all_tokens"), F.lit(0.0)).alias("actual_share"), F.coalesce("documents", zero).alias("documents"), F.coalesce("copies", zero).alias("copies"), F.coalesce("most_copies", F.lit(0)).alias("most_copies"))
    return taken, report
