"""Round trips: the test tables written in the formats of the readers and read again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import mail as ml
from tidemark.plans.ctes import CLEAN, RUN, SUCCESSOR
from tidemark.plans.evaluation import clean_doc, run
from tidemark.plans.graph import successors
from tidemark.session import scratch
from tidemark.sources import readers as rd
from tidemark.sources import writers as wr
from tidemark.sources.tables import table

STOP = ("the", "blue")


def _lines(rows: DataFrame, line: Column) -> str:
    """A folder of text files with a line for each row."""
    path = scratch(rows.sparkSession)
    wr.write_lines(rows.select(line.alias("value")), path)
    return path


def _stored(rows: DataFrame) -> DataFrame:
    path = scratch(rows.sparkSession)
    wr.load(rows, path)
    return rd.pages(rows.sparkSession, path)


def _text(*parts) -> Column:
    return F.concat(*(F.lit(p) if p[:1] in "<\n .'" or p.endswith(" ") else F.col(p).cast("string") for p in parts))


def _sgml(s: SparkSession, d: str) -> str:
    line = _text("<DOC>\n<DOCNO> PART-", "p_partkey", " </DOCNO>\n<HEAD>", "p_brand", "</HEAD>\n<TEXT>\n", "p_name", "\n</TEXT>\n<TEXT>", "p_type", "</TEXT>\n</DOC>")
    return _lines(table(s, d, "part"), line)


def _topics(s: SparkSession, d: str, middle: str) -> str:
    return _lines(table(s, d, "part"), F.concat(F.col("p_partkey").cast("string"), F.lit(middle), "p_name"))


def _qrels(s: SparkSession, d: str) -> str:
    rows = table(s, d, "qrels").withColumn("doc_id", clean_doc()).filter("query_id is not null and doc_id is not null and assessor is not null and grade is not null")
    return _lines(rows, F.concat_ws(" ", F.col("query_id").cast("string"), "assessor", "doc_id", F.col("grade").cast("string")))


def _known_qrels(s: SparkSession, d: str) -> DataFrame:
    some = table(s, d, "topics").filter("query_id is not null and topic_text is not null").select("query_id")
    return rd.qrels(s, _qrels(s, d), some)


def _run(s: SparkSession, d: str) -> DataFrame:
    path = scratch(s)
    wr.write_run(run(s, d), path, depth=100)
    return rd.run(s, path).select("query_id", "q0", "doc_id", "rank", F.round("score", 6).alias("score"), "tag")


def _adjacency(s: SparkSession, d: str) -> DataFrame:
    """In-link lists of at most 50 entries a line."""
    e = successors(s, d)
    lists = e.groupBy(F.col("dst").alias("id"), F.pmod(F.col("src"), F.lit(64)).alias("b")).agg(F.collect_list("src").alias("links"))
    path = scratch(s)
    wr.write_adjacency(lists, path)
    return rd.in_links(s, path)


def _link_maps(s: SparkSession, d: str) -> DataFrame:
    """Out-links of the even vertices and in-links of all."""
    e = successors(s, d)
    part = F.pmod(F.col("src") + F.col("dst"), F.lit(64)).alias("b")
    out = e.filter("src % 2 = 0").groupBy(F.col("src").alias("id"), part).agg(F.collect_list("dst").alias("links"))
    into = e.groupBy(F.col("dst").alias("id"), part).agg(F.collect_list("src").alias("links"))
    return rd.link_maps(out, into)


def _mails(s: SparkSession, d: str) -> DataFrame:
    """A message file for each nation: its name as sender and subject."""
    path = scratch(s)
    raw = F.concat(F.lit("From: "), F.lower(F.regexp_replace("n_name", " ", ".")), F.lit("@example.org\nSubject: "), "n_name", F.lit("\n\nnumber "), F.col("n_nationkey").cast("string"))
    table(s, d, "nation").select("n_nationkey", raw.alias("value")).write.partitionBy("n_nationkey").text(path)
    files = rd.mail_files(s, path)
    return ml.parse_mime(files).select(F.regexp_extract("path", "n_nationkey=(\\d+)", 1).cast("int").alias("n_nationkey"), "from_addr", "subject", F.trim(F.regexp_replace("text", "\\s+", " ")).alias("text"))


def _spam_index(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "emails").filter("email_id is not null and spam is not null").select("email_id", "spam").distinct()
    line = F.concat(F.when(F.col("spam") == 1, "spam").otherwise("ham"), F.lit(" ../data/inmail."), F.col("email_id").cast("string"))
    return rd.spam_index(s, _lines(rows, line), "/mail")


def _phrases(s: SparkSession, d: str) -> DataFrame:
    found = rd.spam_phrases(s, _lines(table(s, d, "part"), F.col("p_type")))
    return found.select("phrase_id", F.concat_ws(" ", "words").alias("words"))


def _feature_rows(s: SparkSession, d: str) -> DataFrame:
    columns = rd.FEATURE_ROWS.names
    rows = table(s, d, "training_features").filter("row_id is not null").select(F.col("row_id").cast("int").alias("index"), "query_id", clean_doc().alias("doc_id"), *columns[3:])
    path = scratch(s)
    wr.write_features(rows, path)
    return rd.feature_rows(s, path).select("index", "query_id", "doc_id", "bm25", "label")


def _truth(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "training_features").withColumn("doc_id", clean_doc()).filter("query_id is not null and doc_id is not null")
    path = scratch(s)
    wr.write_truth(rows.select("query_id", "doc_id", "label").distinct(), path)
    parts = F.split("value", " ")
    return s.read.text(path).select(parts[0].cast("int").alias("query_id"), parts[1].alias("doc_id"), parts[2].cast("double").alias("label"))


def _keyed_load(s: SparkSession, d: str) -> DataFrame:
    path = scratch(s)
    wr.load(table(s, d, "events").select("user_id", "event_id", "event_type"), path, "user_id", "event_id")
    return rd.pages(s, path)


def _updated(s: SparkSession, d: str) -> DataFrame:
    stored = _stored(table(s, d, "supplier").select("s_suppkey", "s_name", "s_acctbal"))
    changes = table(s, d, "supplier").filter("s_suppkey % 3 = 0").select("s_suppkey", F.when(F.col("s_suppkey") % 2 == 0, F.lit(0.0)).alias("s_acctbal"), F.lit("seen").alias("state"))
    return wr.updated(stored, changes, "s_suppkey")


def _without(s: SparkSession, d: str) -> DataFrame:
    stored = _stored(table(s, d, "supplier").select("s_suppkey", "s_name"))
    return wr.without(stored, table(s, d, "supplier").filter("s_nationkey < 5"), "s_suppkey")


def _resumed(s: SparkSession, d: str) -> DataFrame:
    done = _stored(table(s, d, "orders").filter("o_orderstatus = 'F'").select("o_orderkey"))
    return rd.known(table(s, d, "orders").select("o_orderkey", "o_custkey"), "o_orderkey", done)


def _list_run(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "part").select(F.col("p_size").alias("query_id"), F.concat(F.lit("d"), "p_partkey").alias("doc_id"), F.col("p_partkey").alias("pos"))
    return wr.list_as_run(rows)


def _robots(s: SparkSession, d: str) -> DataFrame:
    """Parts as addresses: the brand as host, the words of the name as path."""
    urls = table(s, d, "part").select("p_partkey", F.col("p_brand").alias("host"), F.concat(F.lit("/"), F.regexp_replace("p_name", " ", "/")).alias("path"))
    rules = urls.filter("p_partkey % 7 = 0").select("host", F.substring("path", 1, 5).alias("prefix")).union(s.createDataFrame([("Brand#1", "")], "host string, prefix string"))
    return rd.allowed(urls, rules)


def _clusters(s: SparkSession, d: str) -> DataFrame:
    path = scratch(s)
    wr.store_clusters(table(s, d, "embeddings").select("vec_id", F.col("label").alias("cluster")), path)
    return s.read.parquet(path).filter("cluster < 5").select("vec_id", F.col("cluster").cast("int").alias("cluster"))


def _model(s: SparkSession, d: str) -> DataFrame:
    """Label of each embedding by a stored model, against that of the fitted one: counts of equal and other answers."""
    from pyspark.ml import Pipeline
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    points = table(s, d, "embeddings").select("vec_id", array_to_vector("embedding").alias("features"))
    fitted = Pipeline(stages=[KMeans(k=5, seed=1)]).fit(points)
    path = scratch(s)
    wr.save_model(fitted, path)
    again = rd.load_model(path).transform(points).select("vec_id", F.col("prediction").alias("again"))
    return fitted.transform(points).join(again, "vec_id").agg(F.count_if(F.col("prediction") == F.col("again")).alias("equal"), F.count_if(F.col("prediction") != F.col("again")).alias("other"))


QUERIES = {
    "read_sgml": lambda s, d: rd.sgml_docs(s, _sgml(s, d)).drop("file"),
    "read_sgml_squeezed": lambda s, d: rd.sgml_docs(s, _sgml(s, d), squeeze=True).select("docno", "text"),
    "read_sgml_doc": lambda s, d: rd.sgml_doc(s, _sgml(s, d), "PART-7").select("docno", "head", "text"),
    "read_raw_topics": lambda s, d: rd.raw_topics(s, _topics(s, d, ".   Document will discuss ")),
    "read_edited_topics": lambda s, d: rd.edited_topics(s, _topics(s, d, ".   ")).select("query_id", F.concat_ws(" ", "terms").alias("terms")),
    "read_topic_sets": lambda s, d: rd.topic_sets(s, _topics(s, d, ". "), list(STOP)).select("query_id", F.concat_ws(" ", F.array_sort("terms")).alias("terms")),
    "read_stop_list": lambda s, d: rd.lines(s, _lines(table(s, d, "part"), F.concat(F.lit(" "), "p_brand", F.lit(" "))), "word"),
    "read_qrels": lambda s, d: rd.qrels(s, _qrels(s, d)),
    "read_qrels_known": _known_qrels,
    "read_run": _run,
    "read_in_links": _adjacency,
    "read_in_link_nodes": lambda s, d: rd.in_link_nodes(s, _lines(successors(s, d), F.concat_ws(" ", F.col("dst").cast("string"), F.col("src").cast("string")))),
    "read_link_maps": _link_maps,
    "read_extensions": lambda s, d: rd.extensions(s, _lines(table(s, d, "part"), F.concat(F.lit("."), F.col("p_partkey").cast("string"), F.lit("\ttext/"), F.lower(F.regexp_replace("p_brand", "#", ""))))),
    "read_mail_files": _mails,
    "read_spam_index": _spam_index,
    "read_spam_phrases": _phrases,
    "read_feature_rows": _feature_rows,
    "write_truth": _truth,
    "table_copy": lambda s, d: _stored(table(s, d, "customer")),
    "keyed_load": _keyed_load,
    "keyed_update": _updated,
    "keyed_delete": _without,
    "resumed_load": _resumed,
    "list_as_run": _list_run,
    "robots_allowed": _robots,
    "cluster_store": _clusters,
    "model_store": _model,
}

_QRELS = f"q as (select query_id, assessor, {CLEAN} did, grade from qrels) select query_id, assessor, did doc_id, grade from q where query_id is not null and did is not null and assessor is not null and grade is not null"
_PART_DOC = "'PART-' || p_partkey docno, p_brand head, ' ' || p_name || ' ' || p_type as text from part"
_NO_STOP = "array_to_string(list_sort(list_distinct(list_filter(string_split(p_name, ' '), lambda w: w not in ('the', 'blue') and w <> ''))), ' ')"

ORACLES = {
    "read_sgml": f"select {_PART_DOC}",
    "read_sgml_squeezed": "select 'PART-' || p_partkey docno, p_name || ' ' || p_type as text from part",
    "read_sgml_doc": f"select {_PART_DOC} where p_partkey = 7",
    "read_raw_topics": "select p_partkey::int query_id, lower(regexp_replace(p_name, '(ing|ed|al)$', '')) as text from part",
    "read_edited_topics": "select p_partkey::int query_id, lower(p_name) terms from part",
    "read_topic_sets": f"select p_partkey::int query_id, {_NO_STOP} terms from part",
    "read_stop_list": "select distinct p_brand word from part",
    "read_qrels": f"with {_QRELS}",
    "read_qrels_known": f"with {_QRELS} and query_id in (select query_id from topics where topic_text is not null)",
    "read_run": f"with {RUN} select query_id, 'Q0' q0, doc_id, rank, round(score, 6) score, 'Exp' tag from run where rank <= 100",
    "read_in_links": f"with {SUCCESSOR} select src::varchar src, dst::varchar dst from edges",
    "read_in_link_nodes": f"with {SUCCESSOR} select distinct dst::varchar id from edges",
    "read_link_maps": f"with {SUCCESSOR} select src, dst from edges",
    "read_extensions": "select '.' || p_partkey ext, 'text/' || lower(replace(p_brand, '#', '')) mime from part",
    "read_mail_files": "select n_nationkey, lower(replace(n_name, ' ', '.')) || '@example.org' from_addr, n_name subject, 'number ' || n_nationkey as text from nation",
    "read_spam_index": "select distinct '/mail/data/inmail.' || email_id path, spam, email_id::int doc_id from emails where email_id is not null and spam is not null",
    "read_spam_phrases": "select (row_number() over (order by w) - 1)::int phrase_id, w words from (select distinct lower(p_type) w from part)",
    "read_feature_rows": f"select row_id::int as index, query_id, {CLEAN} doc_id, bm25, label from training_features where row_id is not null",
    "write_truth": f"select distinct query_id, {CLEAN} doc_id, label from training_features where query_id is not null and {CLEAN} is not null and label is not null",
    "table_copy": "select * from customer",
    "keyed_load": "select user_id, max(event_id) event_id, arg_max(event_type, event_id) event_type from events group by user_id",
    "keyed_update": "select s_suppkey, s_name, case when s_suppkey % 6 = 0 then 0 else s_acctbal end s_acctbal, case when s_suppkey % 3 = 0 then 'seen' end state from supplier",
    "keyed_delete": "select s_suppkey, s_name from supplier where s_nationkey >= 5",
    "resumed_load": "select o_orderkey, o_custkey from orders where o_orderkey not in (select o_orderkey from orders where o_orderstatus = 'F')",
    "list_as_run": "select query_id, doc_id, rank, (201 - rank)::double score from (select p_size query_id, 'd' || p_partkey doc_id, row_number() over (partition by p_size order by p_partkey) rank from part)",
    "robots_allowed": "with u as (select p_partkey, p_brand host, '/' || replace(p_name, ' ', '/') path from part), r as (select distinct host, substring(path, 1, 5) prefix from u where p_partkey % 7 = 0) select * from u where not exists (select 1 from r where r.host = u.host and starts_with(u.path, r.prefix))",
    "cluster_store": "select vec_id, label as cluster from embeddings where label < 5",
    "model_store": "select count(*) equal, 0::bigint other from embeddings",
}
