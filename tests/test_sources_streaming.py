"""Readers, writers and streams over files written by the tests."""

import pytest
from pyspark.sql import functions as F

from tidemark.operators import evaluation as ev
from tidemark.operators.index import Index
from tidemark.sources import readers as rd
from tidemark.sources import writers as wr
from tidemark.streaming import ingest

SGML = "<DOC>\n<DOCNO> AP890101-0001 </DOCNO>\n<HEAD>Head</HEAD>\n<TEXT>\nOne  two\n</TEXT>\n<TEXT>three</TEXT>\n</DOC>\n<DOC><DOCNO>AP890101-0002</DOCNO><TEXT>x</TEXT></DOC>"


def put(folder, name, text):
    (folder / name).write_text(text)
    return str(folder / name)


def test_sgml(spark, tmp_path):
    put(tmp_path, "ap890101", SGML)
    put(tmp_path, "readme", "<DOC><DOCNO>no</DOCNO></DOC>")
    got = {r.docno: r for r in rd.sgml_docs(spark, str(tmp_path), glob="ap89*").collect()}
    assert set(got) == {"AP890101-0001", "AP890101-0002"}
    assert got["AP890101-0001"].text == " One  two three" and got["AP890101-0001"].head == "Head"
    assert rd.sgml_docs(spark, str(tmp_path), "ap89*", squeeze=True).filter("docno like '%1'").first().text == "One two three"
    assert rd.sgml_doc(spark, str(tmp_path), "AP890101-0002").first().text == "x"


def test_topics(spark, tmp_path):
    path = put(tmp_path, "t", '85.   Document will discuss ships Sinking\n\n54.   U.S. (the ships), of "steel"\n')
    assert {tuple(r) for r in rd.raw_topics(spark, path).filter("query_id = 85").collect()} == {(85, "ships sink")}
    assert {r.query_id: r.terms for r in rd.edited_topics(spark, path).collect()}[54] == ["u.s.", "(the", "ships),", "of", '"steel"']
    sets = {r.query_id: set(r.terms) for r in rd.topic_sets(spark, path, ["of", "the"]).collect()}
    assert sets[54] == {"U.S.", "ships", "steel"}


def test_judgements_runs_and_links(spark, tmp_path):
    q = rd.qrels(spark, put(tmp_path, "q", "1 a d1 1\n1 b d1 2.5\n2 a d2 x\n"))
    assert {tuple(r) for r in q.collect()} == {(1, "a", "d1", 1.0), (1, "b", "d1", 2.5), (2, "a", "d2", None)}
    assert rd.qrels(spark, str(tmp_path / "q"), spark.createDataFrame([(2,)], "query_id int")).count() == 1
    assert {r.grade for r in ev.summed_grades(q).collect()} == {3.5, 0.0}
    e = rd.in_links(spark, put(tmp_path, "l", "A B C\nD\nB A\n"))
    assert {tuple(r) for r in e.collect()} == {("B", "A"), ("C", "A"), ("A", "B")}
    assert {r.id for r in rd.in_link_nodes(spark, str(tmp_path / "l")).collect()} == {"A", "B", "D"}
    out, into = spark.createDataFrame([("A", ["B"])], "id string, links array<string>"), spark.createDataFrame([("B", ["A", "C"])], "id string, links array<string>")
    assert {tuple(r) for r in rd.link_maps(out, into).collect()} == {("A", "B"), ("C", "B")}


def test_small_files(spark, tmp_path):
    got = {tuple(r) for r in rd.spam_index(spark, put(tmp_path, "i", "spam ../data/inmail.1\nham ../data/inmail.2\n"), "/r").collect()}
    assert got == {("/r/data/inmail.1", 1, 1), ("/r/data/inmail.2", 0, 2)}
    assert [(r.phrase_id, r.words) for r in rd.spam_phrases(spark, put(tmp_path, "p", "buy now\n Act \nbuy now\n")).orderBy("phrase_id").collect()] == [(0, ["act"]), (1, ["buy", "now"])]
    assert rd.extensions(spark, put(tmp_path, "x", ".pdf\tapplication/pdf\n.txt text/plain\n")).count() == 2
    assert {r.url for r in rd.lines(spark, put(tmp_path, "u", "a\n\n a \nb\n")).collect()} == {"a", "b"}
    put(tmp_path, "m.eml", "From: a@b\n\nhello")
    assert rd.mail_files(spark, str(tmp_path / "m.eml")).count() == 1
    header = ",".join(rd.FEATURE_ROWS.names)
    row = rd.feature_rows(spark, put(tmp_path, "f.csv", f"{header}\n0,7,d,1,2,3,4,5,6,7,8,9,10,1\n")).first()
    assert (row.query_id, row.doc_id, row.doc_len, row.label) == (7, "d", 10.0, 1.0)


def test_keyed_writes(spark, tmp_path):
    stored = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "id int, x string, y int")
    changes = spark.createDataFrame([(2, None, "n"), (3, "c", "m")], "id int, x string, z string")
    assert {tuple(r) for r in wr.updated(stored, changes, "id").collect()} == {(1, "a", 1, None), (2, "b", 2, "n"), (3, "c", None, "m")}
    assert {r.id for r in wr.updated(stored, changes, "id", insert=False).collect()} == {1, 2}
    assert {r.id for r in wr.without(stored, changes, "id").collect()} == {1}
    assert {r.id for r in rd.known(stored, "id", changes).collect()} == {1}
    assert wr.with_fields(stored, w=0, x="kept").first().w == 0
    wr.load(spark.createDataFrame([(1, 1, "old"), (1, 2, "new")], "id int, t int, x string"), str(tmp_path / "t"), "id", "t")
    assert [r.x for r in spark.read.parquet(str(tmp_path / "t")).collect()] == ["new"]


def test_run_round_trip(spark, tmp_path):
    run = spark.createDataFrame([(1, "d1", 1, 2.5), (1, "d2", 2, 1.5), (2, "d1", 1, 0.5)], "query_id int, doc_id string, rank long, score double")
    wr.write_run(run, str(tmp_path / "run"), depth=1)
    got = {(r.query_id, r.doc_id, r.rank, r.score, r.tag) for r in rd.run(spark, str(tmp_path / "run")).collect()}
    assert got == {(1, "d1", 1, 2.5, "Exp"), (2, "d1", 1, 0.5, "Exp")}
    listed = wr.list_as_run(spark.createDataFrame([(1, "x", 0), (1, "y", 1)], "query_id int, doc_id string, pos int"))
    assert {tuple(r) for r in listed.collect()} == {(1, "x", 1, 200.0), (1, "y", 2, 199.0)}
    wr.write_features(run.withColumn("part", F.lit("train")), str(tmp_path / "csv"))
    wr.write_truth(run.withColumn("label", F.lit(1.0)), str(tmp_path / "truth"))
    wr.write_adjacency(spark.createDataFrame([("A", ["B"])], "id string, links array<string>"), str(tmp_path / "adj"))
    wr.write_lines(run.select("doc_id"), str(tmp_path / "ids"))
    assert spark.read.option("header", "true").csv(str(tmp_path / "csv")).count() == 3
    assert [r.value for r in spark.read.text(str(tmp_path / "adj")).collect()] == ["A B"]


def test_index_stream_equals_batch(spark, tmp_path):
    rows = [(i, f"word{i % 3} ship") for i in range(10)]
    schema = "doc_id long, text string"
    for k in (0, 1):
        spark.createDataFrame(rows[k * 5 : k * 5 + 5], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    ingest.index_stream(stream, str(tmp_path / "idx"), str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    batch = Index.build(spark.createDataFrame(rows, schema))
    got = {(r.term, r.doc_id, r.tf) for r in spark.read.parquet(str(tmp_path / "idx/postings")).collect()}
    assert got == {(r.term, r.doc_id, r.tf) for r in batch.postings.collect()}


def test_upsert_stream(spark, tmp_path):
    schema = "k int, t int, v string"
    for rows in ([(1, 1, "a"), (2, 1, "b")], [(1, 2, "c")]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    ingest.upsert_stream(stream, str(tmp_path / "out"), str(tmp_path / "cp"), ["k"], "t").trigger(availableNow=True).start().awaitTermination()
    tables = [{tuple(r) for r in spark.read.parquet(str(tmp_path / f"out/{i}")).collect()} for i in (0, 1)]
    assert {(1, 2, "c"), (2, 1, "b")} in tables


def test_windows_and_frontier(spark, tmp_path, small):
    events = spark.read.parquet(f"{small}/events.parquet")
    batch = ingest.windowed_counts(events, size="1 day")
    assert batch.agg(F.sum("n")).first()[0] == events.count()
    events.select("ts", "event_type", "value").coalesce(1).write.parquet(str(tmp_path / "ev"))
    stream = spark.readStream.schema(events.select("ts", "event_type", "value").schema).parquet(str(tmp_path / "ev"))
    q = ingest.windowed_counts(stream, size="1 day").writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("w").count() == batch.count()
    q = ingest.frontier_stream(stream.withColumn("url", F.col("event_type"))).writeStream.format("memory").queryName("f").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("f").count() == events.select("event_type").distinct().count()
