"""Problem 5: near-duplicate records, by bottom-k sketches.

One hash function over the runs of words that similarity is defined on gives each record the
``k`` least values of its runs. A pair that is similar enough shares at least :func:`need` of them
(what a union sketch can lack by chance, 3.7 standard deviations, is allowed for), so that the two
share one of the ``k - need + 1`` values that are rarest in the collection, whichever order is
taken as long as it is one for all. Records enter the inverted lists of these values only. There,
pairs are filtered by size and by a signature of 192 bits; the pairs left over are estimated on
their union sketches, and the rest is verified on the texts. No list is cut: long ones are met in
blocks. All thresholds follow from ``similarity`` and hold for lists of any length.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.text import mixed, shingle_hashes, shingles, words
from tidemark.session import drop_materialized, materialize, ship_package

#: Values kept of each record.
SKETCH = 64
#: Standard deviations of an estimate that are allowed for: one pair in 10,000 at the threshold itself is lost to each filter.
DEVIATIONS = 3.7
#: Bits of the signature.
BITS = 192
#: Two tables of so many counters tell how frequent a value is; a value's estimate is the smaller of its two.
#: They only order the values, so their size, which is fixed, decides speed and not results.
COUNTERS = 1 << 17
#: Records of a list that are met in one block.
BLOCK = 1000
#: Bits of a map of ids at most; like the counters it decides what is shuffled and not results.
MAP_BITS = 1 << 26

_FACTORS = mixed(np.arange(1, BITS + 1, dtype=np.uint64)) | np.uint64(1)


def signature(values: np.ndarray) -> list[int]:
    """192 bits in three longs, each of the value least under its own order: two records agree in a bit with probability (1 + Jaccard) / 2."""
    least, bits = None, None
    x = values.view(np.uint64)
    for at in range(0, len(x), 2048):
        part = x[at : at + 2048, None] * _FACTORS
        now = part.min(axis=0)
        least = now if least is None else np.minimum(least, now)
    bits = np.packbits((mixed(least) & np.uint64(1)).astype(np.uint8))
    return bits.view(np.int64).tolist()


def least_agreeing(similarity: float) -> int:
    """Bits of the signature in which records of that similarity agree at least."""
    p = (1 + similarity) / 2
    return math.floor(BITS * p - DEVIATIONS * math.sqrt(BITS * p * (1 - p)))


def sampled_need(similarity: float, k: int) -> int:
    """Values of a union sketch of ``k`` that records of that similarity both hold at least."""
    return max(1, math.ceil(k * similarity - DEVIATIONS * math.sqrt(k * similarity * (1 - similarity))))


def need(similarity: float, k: int, n: int) -> int:
    """Retained values that a record of ``n`` distinct runs shares at least with any similar one; exact where all are retained."""
    return min(math.ceil(similarity * n - 1e-9), sampled_need(similarity, k))


def _sketcher(size: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            ids, keys, sizes, sketches, signs = [], [], [], [], []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                tokens = words(text)
                if len(tokens) < size:
                    continue
                values = shingle_hashes(tokens, size)
                ids.append(i)
                keys.append(xxhash.xxh128_digest(" ".join(tokens)))
                sizes.append(len(values))
                sketches.append(values[:k])
                signs.append(signature(values))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.binary()), pa.array(sizes, pa.int32()), pa.array(sketches, pa.list_(pa.int64())), *(pa.array([x[c] for x in signs], pa.int64()) for c in range(3))], names=["id", "words", "n", "sketch", "s1", "s2", "s3"])

    return run


def sketch_table(records: DataFrame, key: str, text: str, size: int = 3, k: int = SKETCH) -> DataFrame:
    """(id, words, n, sketch, s1, s2, s3): a digest of the word sequence, the number of distinct runs, the ``k`` least hashes of them, and :func:`signature`."""
    ship_package(records.sparkSession)
    rows = records.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")).filter("id is not null and text is not null")
    return rows.mapInArrow(_sketcher(size, k), "id long, words binary, n int, sketch array<long>, s1 long, s2 long, s3 long")


def _cells(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The cells of both tables that count each value."""
    x = mixed(values.view(np.uint64))
    return (x & np.uint64(COUNTERS - 1)).astype(np.int64), ((x >> np.uint64(32)) & np.uint64(COUNTERS - 1)).astype(np.int64) + COUNTERS


def _counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(cell, c) of one task: at most two tables."""
    table = np.zeros(2 * COUNTERS, dtype=np.int64)
    for batch in batches:
        values = np.asarray(batch.column(0).flatten())
        for cells in _cells(values):
            table += np.bincount(cells, minlength=2 * COUNTERS)
    full = np.flatnonzero(table)
    for at in range(0, len(full), 50_000):
        part = full[at : at + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(table[part])], names=["cell", "c"])


def frequencies(sketches: DataFrame) -> np.ndarray:
    """Both counter tables over all sketches: a quarter of a million numbers reach the driver, whatever the collection."""
    counted = sketches.select("sketch").mapInArrow(_counter, "cell int, c long").groupBy("cell").agg(F.sum("c").alias("c"))
    found = counted.toPandas()
    table = np.zeros(2 * COUNTERS, dtype=np.int64)
    table[found["cell"].to_numpy()] = found["c"].to_numpy()
    return table


def _entries(table, similarity: float, k: int, block: int, long_only: bool):
    """(v, id, n, s1, s2, s3, long) for the rarest retained values of each record; ``long`` where the list may exceed a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = table.value
        for batch in batches:
            column = batch.column(2)
            flat, length = np.asarray(column.flatten()), np.diff(np.asarray(column.offsets))
            if not len(flat):
                continue
            first, second = _cells(flat)
            df = np.minimum(counts[first], counts[second])
            own = np.repeat(np.arange(len(length)), length)
            order = np.lexsort((flat, df, own))
            place = np.arange(len(flat)) - np.repeat(np.concatenate([[0], np.cumsum(length)[:-1]]), length)
            keep = np.array([m - need(similarity, k, n) + 1 for m, n in zip(length.tolist(), batch.column(1).to_pylist())])
            chosen = order[place < np.repeat(keep, length)]
            if long_only:
                chosen = chosen[df[chosen] > block]
                yield pa.RecordBatch.from_arrays([pa.array(flat[chosen])], names=["v"])
                continue
            rows = pa.array(own[chosen])
            others = [batch.column(c).take(rows) for c in (0, 1, 3, 4, 5)]
            yield pa.RecordBatch.from_arrays([pa.array(flat[chosen]), *others, pa.array(df[chosen] > block)], names=["v", "id", "n", "s1", "s2", "s3", "long"])

    return run


def _pairs_of(v, i, j, own, ids, n, signs, similarity: float, agreeing: int) -> np.ndarray:
    """Distinct pairs (two rows) within the runs of equal (v, i, j) that pass the filters of size and signature."""
    same = (v[1:] == v[:-1]) & (i[1:] == i[:-1]) & (j[1:] == j[:-1])
    group = np.concatenate([[0], np.cumsum(~same)])
    signs = [s.view(np.uint64) for s in signs]  # of signed numbers NumPy counts the bits of the absolute value
    found, alive, d = [], np.arange(len(v)), 0
    while True:
        d += 1
        alive = alive[alive + d < len(v)]
        alive = alive[group[alive] == group[alive + d]]
        if not len(alive):
            break
        x, y = alive, alive + d
        least, most = np.minimum(n[x], n[y]), np.maximum(n[x], n[y])
        fine = least >= similarity * most - 1e-9
        x, y = x[fine], y[fine]
        apart = sum(np.bitwise_count(s[x] ^ s[y]).astype(np.int16) for s in signs)
        fine = (apart <= BITS - agreeing) & (ids[x] != ids[y]) & ((i[x] == j[x]) | (own[x] != own[y]))
        if fine.any():
            a, b = ids[x[fine]], ids[y[fine]]
            found.append(np.stack([np.minimum(a, b), np.maximum(a, b)]))
    return np.unique(np.concatenate(found, axis=1), axis=1) if found else np.empty((2, 0), dtype=np.int64)


def _meet(similarity: float, agreeing: int):
    """Pairs (a, b) of rows (v, i, j, own, id, n, s1, s2, s3) that come sorted by list and block; a list runs on into the next batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            table = [np.asarray(batch.column(c)) for c in range(9)]
            if held is not None:
                table = [np.concatenate([x, y]) for x, y in zip(held, table)]
            v, i, j = table[:3]
            if not len(v):
                continue
            last = np.flatnonzero((v != v[-1]) | (i != i[-1]) | (j != j[-1]))
            cut = last[-1] + 1 if len(last) else 0
            held = [x[cut:] for x in table]  # one block of one list at most
            yield from pairs([x[:cut] for x in table])
        if held is not None:
            yield from pairs(held)

    def pairs(t) -> Iterator[pa.RecordBatch]:
        if len(t[0]) > 1:
            a, b = _pairs_of(*t[:6], t[6:], similarity, agreeing)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return run


def candidates(classes: DataFrame, similarity: float, k: int = SKETCH, block: int = BLOCK) -> DataFrame:
    """(a, b), a < b, of records that meet in a list and pass the filters; ``classes`` has (id, n, sketch, s1, s2, s3)."""
    spark = classes.sparkSession
    table = spark.sparkContext.broadcast(frequencies(classes))  # two tables of COUNTERS numbers
    rows = classes.select("id", "n", "sketch", "s1", "s2", "s3")
    entries = rows.mapInArrow(_entries(table, similarity, k, block, False), "v long, id long, n int, s1 long, s2 long, s3 long, long boolean")
    hot = rows.mapInArrow(_entries(table, similarity, k, block, True), "v long").groupBy("v").agg(F.count(F.lit(1)).alias("c"))
    hot = materialize(hot.filter(F.col("c") > block).select("v", F.ceil(F.col("c") / block).cast("int").alias("parts")))
    zero = F.lit(0)
    plain = entries.withColumns({"i": zero, "j": zero, "own": zero})
    if not hot.isEmpty():
        # A long list is split into blocks, and each pair of blocks is a group of its own.
        split = entries.filter("long").join(hot, "v").withColumn("own", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
        split = split.withColumn("other", F.explode(F.sequence(zero, F.col("parts") - 1))).withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")})
        rest = plain.filter("not long").unionByName(plain.filter("long").join(hot, "v", "left_anti"))
        plain = rest.unionByName(split.drop("parts", "other"))
    met = plain.select("v", "i", "j", "own", "id", "n", "s1", "s2", "s3").repartition("v", "i", "j").sortWithinPartitions("v", "i", "j")
    return met.mapInArrow(_meet(similarity, least_agreeing(similarity)), "a long, b long").distinct()


def _estimator(similarity: float, k: int):
    """Pairs whose union sketch (the ``k`` least values of both) holds enough values that both retain."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = [batch.column(c) for c in (2, 3)]
            flats, bounds = [np.asarray(s.flatten()) for s in sides], [np.asarray(s.offsets) - s.offsets[0].as_py() for s in sides]
            keep = []
            for r in range(batch.num_rows):
                x, y = (f[o[r] : o[r + 1]] for f, o in zip(flats, bounds))
                union, times = np.unique(np.concatenate([x, y]), return_counts=True)
                both = int((times[:k] == 2).sum())
                # Of fewer than k values in all nothing is left out, so the share is exact.
                keep.append(both >= (sampled_need(similarity, k) if len(union) >= k else similarity * len(union) - 1e-9))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return run


def _verifier(size: int, similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, left = None, set()
        for batch in batches:
            a, b, js = [], [], []
            for x, tx, y, ty in zip(*(batch.column(c).to_pylist() for c in range(4))):
                if x != last:
                    last, left = x, shingles(words(tx), size)
                right = shingles(words(ty), size)
                both = len(left & right)
                j = both / (len(left) + len(right) - both)
                if j >= similarity - 1e-12:
                    a.append(x), b.append(y), js.append(j)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(js, pa.float64())], names=["a", "b", "similarity"])

    return run


def thinned(rows: DataFrame, ids: DataFrame, most: int = MAP_BITS) -> DataFrame:
    """``rows`` whose id is among ``ids`` (a written table), and a few others: told before any shuffle, by a bit map of the ids that is broadcast."""
    bits = min(most, 1 << max(6, (8 * ids.count()).bit_length()))
    at = F.pmod(F.xxhash64("id"), F.lit(bits))
    word, bit = F.shiftright(at, 6), at.bitwiseAND(F.lit(63)).cast("int")
    words = ids.select(word.alias("word"), bit.alias("bit")).groupBy("word").agg(F.expr("bit_or(shiftleft(1L, bit))").alias("held"))
    # At most MAP_BITS / 64 rows. A semi join, so that the planner neither pulls the join by id below it nor leaves it above a repartition.
    return rows.join(F.broadcast(words), (word == F.col("word")) & (F.getbit("held", bit) == 1), "left_semi")


def _of_pairs(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """One row for each id that ``pairs`` hold; the others are not shuffled, but for a few."""
    ids = materialize(pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct())
    return thinned(rows, ids).join(ids, "id", "left_semi").dropDuplicates(["id"])


def _sides(pairs: DataFrame, rows: DataFrame, value: str) -> DataFrame:
    """``pairs`` with the value of either end."""
    a, b = (rows.select(F.col("id").alias(x), F.col(value).alias(f"{value}_{x}")) for x in "ab")
    return pairs.join(b, "b").join(a, "a").select("a", f"{value}_a", "b", f"{value}_b")


def near_duplicates(records: DataFrame, key: str, text: str, size: int = 3, similarity: float = 0.6, k: int = SKETCH, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """Membership (id, rep) of all records of at least ``size`` words, and pairs (a, b, similarity) of different reps.

    Records of equal word sequences form a class under its smallest id; pairs are between
    classes, a < b, with exact similarity of their sets of ``size``-word runs of at least
    ``similarity``. Null texts and ids and shorter texts are left out; rows delivered twice
    count once; other columns are not looked at; an empty table gives two empty frames. No list
    is cut, and no threshold depends on a list's length.
    """
    made = materialize(sketch_table(records, key, text, size, k))
    member = made.select("id", "words").distinct()
    member = materialize(member.join(member.groupBy("words").agg(F.min("id").alias("rep")), "words").select("id", "rep"))
    # The copies are written first, so that the planner knows whether they are few, and the classes once for all that read them.
    copies = materialize(member.filter("id != rep").select("id"))
    classes = materialize(made.join(copies, "id", "left_anti").drop("words"))
    drop_materialized(made)
    pairs = materialize(candidates(classes, similarity, k, block))
    sketches = _of_pairs(classes.select("id", "sketch"), pairs)
    likely = materialize(_sides(pairs, sketches, "sketch").select("a", "b", "sketch_a", "sketch_b").mapInArrow(_estimator(similarity, k), "a long, b long"))
    drop_materialized(classes)
    texts = materialize(_of_pairs(records.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")), likely))
    return member, _sides(likely, texts, "text").mapInArrow(_verifier(size, similarity), "a long, b long, similarity double")


def expand_pairs(member: DataFrame, pairs: DataFrame) -> DataFrame:
    """All pairs of records (a < b): of different classes in ``pairs``, and within a class.

    Only for a result that has to list pairs: m exact copies give m (m - 1) / 2 rows.
    :func:`duplicate_classes` has a row for each record instead.
    """
    left, right = member.select(F.col("id").alias("x"), F.col("rep").alias("a")), member.select(F.col("id").alias("y"), F.col("rep").alias("b"))
    across = pairs.select("a", "b").join(left, "a").join(right, "b").select("x", "y")
    same = left.join(right.withColumnRenamed("b", "a"), "a").filter("x < y").select("x", "y")
    return across.unionByName(same).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def duplicate_classes(member: DataFrame, pairs: DataFrame) -> DataFrame:
    """(id, rep, links): a row for each record, with its class and the number of other classes similar to it."""
    both = pairs.select(F.col("a").alias("rep")).union(pairs.select(F.col("b").alias("rep")))
    links = both.groupBy("rep").agg(F.count(F.lit(1)).alias("links"))
    return member.join(links, "rep", "left").select("id", "rep", F.coalesce("links", F.lit(0)).cast("long").alias("links"))
