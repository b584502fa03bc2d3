"""E-mail features over the e-mail table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import analysis as an
from tidemark.operators import index as ix
from tidemark.operators import mail as ml
from tidemark.operators import ranking as rk
from tidemark.plans.ctes import TOKENS
from tidemark.sources.tables import table

PHRASES = ("order your", "reply today", "no doctor needed", "dear friend", "account", "prize", "now and save", "urgent")


def mails(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "emails").filter("email_id is not null").distinct()


def headers(s: SparkSession, d: str) -> DataFrame:
    """The mails with the headers that the table lacks, made from its columns: some replies go elsewhere, some
    mails have blind copies only, and some message ids are of another host."""
    host = F.when(F.col("email_id") % 7 == 0, "elsewhere.example").otherwise(ml.domain(ml.address("from_addr")))
    none = F.col("email_id") % 10 == 0
    return mails(s, d).select(
        "email_id", "subject", "text", "from_addr", F.when(none, "").otherwise(F.col("to_addr")).alias("to_addr"),
        F.when(F.col("email_id") % 4 == 0, F.col("to_addr")).alias("reply_to"), F.when(none & (F.col("email_id") % 20 == 0), F.col("from_addr")).alias("bcc"),
        F.concat(F.lit("<m"), F.col("email_id").cast("string"), F.lit("@"), host, F.lit(">")).alias("message_id"),
    )


def _flags(compat: bool):
    return lambda s, d: ml.header_flags(headers(s, d), compat).select("email_id", *ml.HEADERS[:6])


def _dictionary(s: SparkSession, d: str) -> DataFrame:
    """All words of the topics' texts, as they are written."""
    return table(s, d, "topics").select(F.explode(F.split("topic_text", r"\s+")).alias("word")).distinct()


def _phrases(s: SparkSession) -> DataFrame:
    return s.createDataFrame([(i, p.split()) for i, p in enumerate(PHRASES)], "phrase_id int, words array<string>")


def _phrase_freqs(s: SparkSession, d: str) -> DataFrame:
    return rk.phrase_freq(an.tokens(mails(s, d).select("email_id", "text"), "email_id"), _phrases(s), "email_id").select("email_id", "phrase_id", "freq")


def _matrix(s: SparkSession, d: str) -> DataFrame:
    return ml.feature_matrix(mails(s, d), _phrase_freqs(s, d), "email_id")


def _split(s: SparkSession, d: str) -> DataFrame:
    return ml.stratified_split(mails(s, d).select("email_id", "spam"), "spam", "email_id")


def _unigrams(s: SparkSession, d: str) -> DataFrame:
    """All mails over the vocabulary of the training part."""
    split = _split(s, d)
    posts = ix.postings(an.tokens(mails(s, d).select("email_id", "text"), "email_id"), "email_id")
    train = posts.join(split.filter("part = 'train'").select("email_id"), "email_id", "left_semi")
    return ml.unigram_matrix(posts, ml.vocabulary(train), "email_id")


TREES = 300


def _fitted(s: SparkSession, d: str, kind: str):
    """(model, test part, names of the columns): a random forest on headers and phrases, or a logistic regression on all training terms."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
    from pyspark.ml.feature import CountVectorizer, VectorAssembler

    rows = mails(s, d).filter("spam is not null")
    split = rows.join(_split(s, d).select("email_id", "part"), "email_id").withColumn("terms", F.coalesce(an.index_terms("text"), F.array().cast("array<string>")))
    data = split.select("email_id", F.col("spam").cast("double").alias("label"), "part", "terms", *(F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ml.HEADERS), *((F.coalesce(F.instr(F.lower("text"), p), F.lit(0)) > 0).cast("int").alias(f"p{i}") for i, p in enumerate(PHRASES)))
    columns = [*ml.HEADERS, *(f"p{i}" for i in range(len(PHRASES)))]
    if kind == "rf":
        stages = [VectorAssembler(inputCols=columns, outputCol="x"), RandomForestClassifier(featuresCol="x", numTrees=TREES, maxDepth=6, seed=1)]
    else:
        stages = [CountVectorizer(inputCol="terms", outputCol="x", minDF=1, vocabSize=1 << 20), LogisticRegression(featuresCol="x", regParam=0.01, maxIter=20)]
    model = Pipeline(stages=stages).fit(data.filter("part = 'train'"))
    names = [*ml.HEADERS, *PHRASES] if kind == "rf" else model.stages[0].vocabulary
    return model, data.filter("part = 'test'"), names


def _fit(kind: str):
    def query(s: SparkSession, d: str) -> DataFrame:
        """Held-out accuracy of a spam classifier."""
        model, test, _ = _fitted(s, d, kind)
        return model.transform(test).agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("prediction") == F.col("label")).cast("double")).alias("accuracy"))

    return query


def _weights(kind: str, most: int = 200):
    def query(s: SparkSession, d: str) -> DataFrame:
        """(place, name, weight) of the columns that tell most: importances of the forest, coefficients of the regression by their size."""
        model, _, names = _fitted(s, d, kind)
        last = model.stages[-1]
        values = (last.featureImportances if kind == "rf" else last.coefficients).toArray()
        order = sorted(range(len(values)), key=lambda i: (-abs(values[i]), names[i]))[:most]
        return s.createDataFrame([(k + 1, names[i], float(values[i])) for k, i in enumerate(order)], "place int, name string, weight double")

    return query


def _mime(s: SparkSession, d: str) -> DataFrame:
    """The mails as messages of two parts, parsed again."""
    rows = mails(s, d)
    text, sender = F.coalesce("text", F.lit("")), F.coalesce("from_addr", F.lit(""))
    raw = F.concat(F.lit("From: "), sender, F.lit('\nMIME-Version: 1.0\nReceived: from b; Mon, 2 Jan 2006 17:05:05 EST\nReceived: from a; Mon, 2 Jan 2006 15:04:05 -0700\nContent-Type: multipart/alternative; boundary="b0b"\n\n--b0b\nContent-Type: text/plain; charset=utf-8\nContent-Transfer-Encoding: 8bit\n\n'), text, F.lit("\n--b0b\nContent-Type: text/html\n\n<p>as <b>html</b></p>\n--b0b--\n"))
    parsed = ml.parse_mime(rows.select(F.col("email_id").cast("string").alias("path"), F.encode(raw, "utf-8").alias("content")))
    return ml.chosen_headers(parsed).select(F.col("path").cast("long").alias("email_id"), "from_addr", "servers_count", "span_time", "wrong_time", F.trim(F.regexp_replace("text", "\\s+", " ")).alias("text"))


QUERIES = {
    "clean_text": lambda s, d: mails(s, d).select("email_id", ml.clean_text("text").alias("text")),
    "english_only": lambda s, d: ml.dictionary_words(mails(s, d).select("email_id", ml.clean_text("text").alias("text")), _dictionary(s, d), "email_id"),
    "header_flags": _flags(False),
    "header_flags_compat": _flags(True),
    "spam_phrase_features": _phrase_freqs,
    "spam_matrix": _matrix,
    "spam_rf_importances": _weights("rf"),
    "spam_lr_coefficients": _weights("lr"),
    "train_test_split": _split,
    "unigram_matrix": _unigrams,
    "mime_text": _mime,
    "spam_rf": _fit("rf"),
    "spam_lr": _fit("lr"),
    "sender_domain": lambda s, d: mails(s, d).select("email_id", ml.address("from_addr").alias("address"), ml.domain(ml.address("from_addr")).alias("domain")),
}

_MAILS = "m as (select distinct * from emails where email_id is not null)"
_ADDR = "lower(list_extract(list_filter(list_transform(regexp_split_to_array({c}, '[<>]'), lambda p: trim(p)), lambda p: p <> ''), -1))"
_GREEK = "[\u0391-\u03a9\u03b1-\u03c9]"
_CLEAN = "trim(regexp_replace(text, '[^a-zA-Z0-9\\\\$%'']+', ' ', 'g'))"


_HEADERS = f"h as (select email_id, subject, text, from_addr, case when email_id % 10 = 0 then '' else to_addr end to_addr, case when email_id % 4 = 0 then to_addr end reply_to, case when email_id % 20 = 0 then from_addr end bcc, case when email_id % 7 = 0 then 'elsewhere.example' else lower(split_part({_ADDR.format(c='from_addr')}, '@', -1)) end id_host from m)"


def _flag_sql(subject: str) -> str:
    return f"with {_MAILS}, {_HEADERS}, a as (select *, {_ADDR.format(c='from_addr')} sender, {_ADDR.format(c='reply_to')} reply from h) select email_id, (regexp_matches(coalesce(from_addr, ''), '{_GREEK}') or regexp_matches(coalesce(reply_to, ''), '{_GREEK}'))::int weird_char, coalesce(reply <> '' and sender <> reply, false)::int weird_addr, ({subject})::int weird_sbj, (trim(coalesce(to_addr, '')) = '' and trim(coalesce(bcc, '')) <> '')::int weird_target, (trim(coalesce(text, '')) = '')::int weird_content, coalesce(id_host <> lower(split_part(sender, '@', -1)), false)::int weird_msg_id from a"


_SPLIT = f"{_MAILS}, r as (select email_id, spam, row_number() over (partition by spam order by md5(email_id::varchar), email_id) k, count(*) over (partition by spam) n from m), split as (select email_id, spam, case when k <= floor(0.2 * n) then 'test' else 'train' end part from r)"
_PH = "ph as (select * from (values " + ", ".join(f"({i}, {k}, '{t}', {len(p.split())})" for i, p in enumerate(PHRASES) for k, t in enumerate(p.split())) + ") t(phrase_id, k, term, len))"
_MTOK = TOKENS.replace("documents", "documents_")

ORACLES = {
    "clean_text": f"with {_MAILS} select email_id, {_CLEAN} as text from m",
    "english_only": f"with {_MAILS}, dic as (select distinct unnest(regexp_split_to_array(topic_text, '\\s+')) w from topics), c as (select email_id, {_CLEAN} t from m), x as (select email_id, unnest(regexp_split_to_array(t, '\\s+')) w, generate_subscripts(regexp_split_to_array(t, '\\s+'), 1) i from c), k as (select email_id, lower(string_agg(w, ' ' order by i)) l from x where w <> '' and w in (select w from dic) group by all) select email_id, case when t is not null then coalesce(l, '') end as text from c left join k using (email_id)",
    "header_flags": _flag_sql(f"regexp_matches(coalesce(subject, ''), '{_GREEK}') or regexp_matches(coalesce(subject, ''), '[$%!*#@^~]')"),
    "header_flags_compat": _flag_sql("length(coalesce(subject, '')) > 0"),
    "spam_phrase_features": f"with {_MAILS}, documents_ as (select email_id doc_id, text from m), {_MTOK}, ph as (select * from (values " + ", ".join(f"({i}, {k}, '{t}', {len(p.split())})" for i, p in enumerate(PHRASES) for k, t in enumerate(p.split())) + ") t(phrase_id, k, term, len)), b as (select phrase_id, doc_id, pos - k begin_, len, count(*) met from tokens join ph using (term) group by all) select doc_id email_id, phrase_id, count(*) freq from b where met = len group by all",
    "train_test_split": f"with {_SPLIT} select * from split",
    "unigram_matrix": f"with {_SPLIT}, documents_ as (select email_id doc_id, text from m), {_MTOK}, post as materialized (select term, doc_id, count(*) tf from tokens group by all), train as materialized (select email_id doc_id from split where part = 'train'), seen as materialized (select distinct term from post semi join train using (doc_id)), vocab as materialized (select term, row_number() over (order by term) - 1 col_id from seen) select doc_id row_id, col_id, tf as value from post join vocab using (term)",
    "spam_matrix": f"with {_MAILS}, documents_ as (select email_id doc_id, text from m), {_MTOK}, {_PH}, b as (select phrase_id, doc_id, pos - k begin_, len, count(*) met from tokens join ph using (term) group by all), head as (" + " union all ".join(f"select email_id row_id, {i}::bigint col_id, {c}::double as value from m where {c} <> 0" for i, c in enumerate(ml.HEADERS)) + f") select * from head union all select doc_id, phrase_id + {len(ml.HEADERS)}, count(*) from b where met = len group by doc_id, phrase_id",
    "mime_text": f"with {_MAILS} select email_id, coalesce(from_addr, '') from_addr, 2 servers_count, 60 span_time, 0 wrong_time, trim(regexp_replace(coalesce(text, '') || ' as html', '\\s+', ' ', 'g')) as text from m",
    "sender_domain": f"with {_MAILS} select email_id, {_ADDR.format(c='from_addr')} address, lower(split_part({_ADDR.format(c='from_addr')}, '@', -1)) as domain from m",
}
ORACLES = {k: v for k, v in ORACLES.items() if v}
