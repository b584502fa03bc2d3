"""Readers of collections, topics, judgements, runs, links, mails and features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QRELS = "query_id int, assessor string, doc_id string, grade double"
RUN = "query_id int, q0 string, doc_id string, rank long, score double, tag string"
FEATURE_ROWS = T.StructType(
    [T.StructField("index", T.IntegerType()), T.StructField("query_id", T.IntegerType()), T.StructField("doc_id", T.StringType())]
    + [T.StructField(c, T.DoubleType()) for c in ("okapi_tf", "tf_idf", "bm25", "laplace", "jm", "title_unique_term", "text_unique_term", "text_term_appeared_in_query_len", "title_term_appeared_in_query_len", "doc_len", "label")]
)


def sgml_docs(spark: SparkSession, path: str, glob: str | None = None, joiner: str = "", squeeze: bool = False, keep_lines: bool = False) -> DataFrame:
    """(file, docno, head, text) of ``<DOC>`` records, any number in a file.

    White space is taken out of the number; all text blocks are joined by ``joiner``; line ends become
    blanks unless ``keep_lines``; ``squeeze`` collapses white space. Missing parts are empty.
    ``glob`` filters file names. A file is one row until its records are split, so files should
    be of the size collections are delivered in.
    """
    reader = spark.read
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    files = reader.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), "value")
    docs = files.select("file", F.explode(F.regexp_extract_all("value", F.lit(r"(?is)<doc>(.*?)</doc>"), F.lit(1))).alias("d"))
    blocks = lambda tag: F.regexp_extract_all("d", F.lit(rf"(?is)<{tag}>(.*?)</{tag}>"), F.lit(1))
    flat = lambda c: c if keep_lines else F.regexp_replace(c, r"\r?\n", " ")
    text = flat(F.array_join(blocks("text"), joiner))
    head = F.trim(flat(F.array_join(blocks("head"), " ")))
    if squeeze:
        text = F.regexp_replace(F.trim(text), r"\s+", " ")
    return docs.select("file", F.regexp_replace(F.array_join(blocks("docno"), ""), r"\s", "").alias("docno"), head.alias("head"), text.alias("text"))


def sgml_doc(spark: SparkSession, path: str, docno: str) -> DataFrame:
    """The record of one number, looked for only in the file its prefix names."""
    return sgml_docs(spark, path, glob=docno.split("-")[0].lower() + "*").filter(F.col("docno") == docno)


def raw_topics(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, text) of lines such as ``85.   Document will discuss ...``: the first three words and a final ing, ed or al of the whole dropped, lower case."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    rest = F.regexp_extract("value", r"^\s*\d+. +(?:\S* ){0,3}(.*)$", 1)
    return lines.select(F.regexp_extract("value", r"^\s*(\d+)", 1).cast("int").alias("query_id"), F.lower(F.regexp_replace(rest, r"(ing|ed|al)$", "")).alias("text"))


def edited_topics(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, terms) of lines ``54.   contract agreement ...``: lower-cased pieces, punctuation kept."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    terms = F.filter(F.split(F.lower(F.regexp_replace("value", r"^\s*\d+\.?", "")), r"\s+"), lambda t: t != "")
    return lines.select(F.regexp_extract("value", r"^\s*(\d+)", 1).cast("int").alias("query_id"), terms.alias("terms"))


def topic_sets(spark: SparkSession, path: str, stop: list[str] | None = None) -> DataFrame:
    """(query_id, terms): the distinct pieces of distinct lines, cut at punctuation, without stop words."""
    from tidemark.operators.analysis import query_set

    lines = spark.read.text(path).select(F.trim("value").alias("value")).filter("value != ''").distinct()
    return lines.select(F.regexp_extract("value", r"^(\d+)", 1).cast("int").alias("query_id"), query_set(F.regexp_replace("value", r"^\d+\.?\s*", ""), stop or []).alias("terms"))


def _split_fields(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    """Fields between white space, cast to the schema; short lines have nulls."""
    parts = F.split(F.trim("value"), r"\s+")
    schema = T.StructType.fromDDL(ddl)
    return spark.read.text(path).filter(F.trim("value") != "").select(*(F.get(parts, F.lit(i)).try_cast(f.dataType).alias(f.name) for i, f in enumerate(schema)))


def qrels(spark: SparkSession, path: str, queries: DataFrame | None = None) -> DataFrame:
    """Judgements (query_id, assessor, doc_id, grade), of known ``queries`` only where given."""
    rows = _split_fields(spark, path, QRELS)
    return rows.join(queries.select("query_id").distinct(), "query_id", "left_semi") if queries is not None else rows


def run(spark: SparkSession, path: str) -> DataFrame:
    """A ranked run (query_id, q0, doc_id, rank, score, tag)."""
    return _split_fields(spark, path, RUN)


def in_links(spark: SparkSession, path: str) -> DataFrame:
    """(src, dst) of lines ``node in1 in2 ...``; nodes without in-links are not edges (see :func:`in_link_nodes`)."""
    parts = F.split(F.trim("value"), r"\s+")
    lines = spark.read.text(path).filter(F.trim("value") != "").select(parts.alias("p"))
    return lines.select(F.explode(F.slice("p", 2, F.greatest(F.size("p") - 1, F.lit(0)))).alias("src"), F.get("p", F.lit(0)).alias("dst")).select("src", "dst")


def in_link_nodes(spark: SparkSession, path: str) -> DataFrame:
    """(id) of all nodes that a line begins with."""
    return spark.read.text(path).filter(F.trim("value") != "").select(F.get(F.split(F.trim("value"), r"\s+"), F.lit(0)).alias("id")).distinct()


def link_maps(out_links: DataFrame, in_links_: DataFrame) -> DataFrame:
    """Distinct (src, dst) of two adjacency tables (id, links array), outgoing and incoming."""
    out = out_links.select(F.col("id").alias("src"), F.explode("links").alias("dst"))
    into = in_links_.select(F.explode("links").alias("src"), F.col("id").alias("dst"))
    return out.union(into).distinct()


def lines(spark: SparkSession, path: str, column: str = "url") -> DataFrame:
    """Distinct non-blank lines, trimmed."""
    return spark.read.text(path).select(F.trim("value").alias(column)).filter(F.col(column) != "").distinct()


def extensions(spark: SparkSession, path: str) -> DataFrame:
    """(ext, mime) of lines ``.ext mime/type``."""
    return _split_fields(spark, path, "ext string, mime string")


def mail_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of message files, for :func:`tidemark.operators.mail.parse_mime`."""
    return spark.read.format("binaryFile").load(path).select("path", "content")


def spam_index(spark: SparkSession, path: str, root: str = "") -> DataFrame:
    """(path, spam, doc_id) of lines ``spam ../data/inmail.1``."""
    value = F.trim("value")
    name = F.regexp_extract(value, r"([^/\s]+)/([^/\s]+)$", 0)
    rows = spark.read.text(path).filter(F.trim("value") != "")
    return rows.select(F.concat(F.lit(root.rstrip("/") + "/" if root else ""), name).alias("path"), (F.get(F.split(value, r"\s+"), F.lit(0)) == "spam").cast("int").alias("spam"), F.regexp_extract(value, r"\.(\d+)$", 1).try_cast("int").alias("doc_id"))


def spam_phrases(spark: SparkSession, path: str) -> DataFrame:
    """(phrase_id, words) of the distinct phrases of a file, numbered in their alphabetical order. A list of a few thousand at most."""
    from pyspark.sql.window import Window

    distinct = lines(spark, path, "phrase").select(F.lower("phrase").alias("phrase")).distinct()
    return distinct.select((F.row_number().over(Window.orderBy("phrase")) - 1).alias("phrase_id"), F.split("phrase", r"\s+").alias("words"))


def feature_rows(spark: SparkSession, path: str) -> DataFrame:
    """Learning-to-rank rows from CSV with a header, under a fixed schema."""
    return spark.read.schema(FEATURE_ROWS).option("header", "true").csv(path)


def pages(spark: SparkSession, path: str) -> DataFrame:
    """Crawled pages kept as Parquet; only the columns asked for are read."""
    return spark.read.parquet(path)


def known(rows: DataFrame, key: str, done: DataFrame) -> DataFrame:
    """``rows`` whose ``key`` is not in ``done`` yet: resumes an interrupted load."""
    return rows.join(done.select(key).distinct(), key, "left_anti")


def grade_column(grade: Column) -> Column:
    """A grade as float, 0 where none is given."""
    return F.coalesce(grade.cast("double"), F.lit(0.0))


def load_model(path: str):
    """A pipeline saved by :func:`tidemark.sources.writers.save_model`."""
    from pyspark.ml import PipelineModel

    return PipelineModel.load(path)


def allowed(urls: DataFrame, rules: DataFrame, host: str = "host", path: str = "path") -> DataFrame:
    """Addresses that no rule (host, prefix) forbids: a path is kept out by any prefix of it, an empty prefix forbids nothing.

    Prefixes are met by equality, one for each length that the rules use, so that no product of
    addresses and rules is formed. A null path counts as /.
    """
    wanted = rules.filter("prefix is not null and prefix != ''").select(F.col(host).alias("_h"), F.col("prefix").alias("_p")).distinct()
    sizes = wanted.select("_h", F.length("_p").alias("_n")).distinct().groupBy("_h").agg(F.collect_list("_n").alias("_ns"))  # distinct lengths of a host's rules
    whole = F.coalesce(path, F.lit("/"))
    asked = urls.select(host, path).distinct().join(sizes, F.col(host) == F.col("_h")).select(host, path, F.explode("_ns").alias("_n"))
    shut = asked.select(host, path, F.substring(whole, F.lit(1), F.col("_n")).alias("_p")).join(wanted.withColumnRenamed("_h", host), [host, "_p"], "left_semi").select(F.col(host).alias("_h"), F.col(path).alias("_q")).distinct()
    return urls.join(shut, F.col(host).eqNullSafe(F.col("_h")) & F.col(path).eqNullSafe(F.col("_q")), "left_anti")
