"""Problem 6: how distinctive a term is per record."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.text import one_row_each, words
from tidemark.session import materialize, ship_package

K1, B = 1.2, 0.75
#: Terms counted in a task before its counts are passed on; only memory depends on it.
FLUSH = 300_000


def _pass(min_tf: int):
    """(kind, record_id, term, tf, dl) of each word of each record, and with null id the counts of the task.

    A count row has the records that hold the term in tf; the one without term has the records in tf and
    their words in dl.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter] = {}
        whole: dict[str, list[int]] = {}
        rows: list[tuple] = []

        def out() -> pa.RecordBatch:
            cols = list(zip(*rows)) or [[]] * 5
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()))], names=["kind", "record_id", "term", "tf", "dl"])

        for batch in batches:
            for kind, i, text in zip(*(batch.column(c).to_pylist() for c in range(3))):
                found = Counter(words(text))
                n = found.total()
                both = whole.setdefault(kind, [0, 0])
                both[0] += 1
                both[1] += n
                counts.setdefault(kind, Counter()).update(found.keys())
                rows += [(kind, i, term, tf, n) for term, tf in found.items() if tf >= min_tf]
                if len(rows) > 50_000:
                    yield out()
            if sum(map(len, counts.values())) > FLUSH:
                rows += [(kind, None, t, c, 0) for kind, of in counts.items() for t, c in of.items()]
                counts.clear()
                yield out()
        rows += [(kind, None, t, c, 0) for kind, of in counts.items() for t, c in of.items()]
        rows += [(kind, None, None, n, length) for kind, (n, length) in whole.items()]
        yield out()

    return run


def term_weights(records: DataFrame, min_tf: int = 1, k1: float = K1, b: float = B) -> DataFrame:
    """(kind, record_id, term, tf, df, weight) of each word of each record.

    ``records``: (kind string, record_id long, text string). Rows of one kind and id count once, the greatest text of unlike ones.
    Weight: ln(1 + (N - df + 0.5) / (df + 0.5)) times tf (k1 + 1) / (tf + k1 (1 - b + b dl / avgdl)),
    where N, df and the mean length are counted over all records of the kind. Records of null or
    empty text count in N with length 0 and give no rows; null ids are left out; an empty table
    gives no rows. ``min_tf`` leaves out words that occur less often in the record, before
    anything is joined; the counts it is held against stay whole.

    Each text is taken apart once. Document counts are taken in the same pass, so that their
    shuffle has one row for each term and task, however many records hold it.
    """
    ship_package(records.sparkSession)
    rows = records.select("kind", F.col("record_id").cast("long").alias("record_id"), "text").filter("record_id is not null and kind is not null")
    made = materialize(one_row_each(rows, ["kind", "record_id"]).mapInArrow(_pass(min_tf), "kind string, record_id long, term string, tf long, dl long"))
    counts = made.filter("record_id is null").groupBy("kind", "term").agg(F.sum("tf").alias("df"), F.sum("dl").alias("length"))
    stats = counts.filter("term is null").select("kind", F.col("df").alias("n"), (F.col("length") / F.col("df")).alias("avgdl"))
    postings = made.filter("record_id is not null").withColumn("tf", F.col("tf").cast("int"))
    found = postings.join(counts.filter("term is not null").select("kind", "term", "df"), ["kind", "term"])
    found = found.join(F.broadcast(stats), "kind")  # one row for each kind of record
    idf = F.log1p((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    tf = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    return found.select("kind", "record_id", "term", "tf", "df", (idf * tf).alias("weight"))
