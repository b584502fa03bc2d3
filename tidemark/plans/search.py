"""Index statistics and ranked retrieval: topics over documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import analysis as an
from tidemark.operators import blocks as bl
from tidemark.operators import index as ix
from tidemark.operators import proximity as px
from tidemark.operators import ranking as rk
from tidemark.plans.ctes import BM25, INDEX, OKAPI, SEARCH, TOKENS, ranked
from tidemark.session import spread
from tidemark.sources.tables import table

# Parameters of the registered queries: categories, phrases and words that the collections hold.
CATEGORIES = (("vessel", ("vessel", "hull", "lifeboat", "crew")), ("place", ("harbour", "pier", "dock", "wharf")), ("money", ("loan", "bank", "bond", "market")))
PHRASES = (("crew of the",), ("officials in",), ("a captain expert",), ("the crew of the",))
NEEDLE = "cancel"
WANTED = ("the", "harbour", "lifeboat", "u.s.", "nosuchterm")
#: Entries of a merged list in one row; small, so that the test data have terms of several blocks.
LIST_BLOCK = 500
MARKED = ["harbour", "crew", "vessel"]


def documents(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "documents").select("doc_id", "text"), "doc_id")


def built(spark: SparkSession, d: str, positions: bool = False) -> ix.Index:
    return ix.Index.build(documents(spark, d), positions=positions)


def topic_terms(spark: SparkSession, d: str) -> DataFrame:
    """(query_id, term, qtf) of the topics under the index tokenizer."""
    raw = table(spark, d, "topics").filter("query_id is not null").select("query_id", F.explode("terms").alias("x"))
    return raw.select("query_id", F.explode(an.index_terms("x")).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qtf"))


def categories(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(c, t) for c, ts in CATEGORIES for t in ts], "category string, term string")


def phrases(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, p[0].split()) for i, p in enumerate(PHRASES)], "phrase_id int, words array<string>")


def _ranked(model: str, depth: int = rk.DEPTH, descending_ids: bool = False):
    return lambda s, d: rk.run_of(bl.Parts.build(documents(s, d)), topic_terms(s, d), model, depth, descending_ids)


def _category_bm25(s: SparkSession, d: str) -> DataFrame:
    out = rk.category_scores(built(s, d), categories(s))
    return out.select("doc_id", F.round("score", 6).alias("score"))


def _topic_score(s: SparkSession, d: str) -> DataFrame:
    i = built(s, d)
    return rk.topic_scores(i.postings, i.docs, categories(s)).select("doc_id", F.round("score", 6).alias("score"))


def _crawl_priority(s: SparkSession, d: str) -> DataFrame:
    pages = table(s, d, "page_text_table").filter("page_id is not null").groupBy("page_id").agg(F.first("text").alias("text"), F.first("crawl_depth").alias("crawl_depth"))
    posts = ix.postings(an.tokens(pages, "page_id").withColumnRenamed("page_id", "doc_id"))
    lengths = ix.doc_lengths(pages, "page_id").withColumnRenamed("page_id", "doc_id")
    scores = rk.topic_scores(posts, lengths, categories(s)).join(pages.select(F.col("page_id").alias("doc_id"), (F.lit(1.0) / (1 + F.col("crawl_depth"))).alias("parent_score")), "doc_id")
    return rk.crawl_priority(scores).select(F.col("doc_id").alias("page_id"), F.round("page_score", 6).alias("page_score"), F.round("child_score", 6).alias("child_score"))


def _search_highlight(s: SparkSession, d: str) -> DataFrame:
    """Top 200 of a free-text search, the whole text marked, and its first 150 characters."""
    query = s.createDataFrame([(1, t, 1) for t in MARKED], "query_id int, term string, qtf long")
    first = rk.top(rk.bm25_scores(built(s, d), query), 200)
    return first.join(documents(s, d), "doc_id").select("doc_id", "rank", "score", rk.highlighted(F.col("text"), MARKED).alias("marked"), F.substring("text", 1, 150).alias("snippet"))


def _hits_assessed(s: SparkSession, d: str) -> DataFrame:
    """The first hits of a search with the grades given so far: labels of the embeddings of the same numbers."""
    from tidemark.operators.evaluation import with_assessments

    given = table(s, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("label").alias("grade"))
    query = s.createDataFrame([(1, t, 1) for t in MARKED], "query_id int, term string, qtf long")
    return with_assessments(rk.top(rk.bm25_scores(built(s, d), query), 200), given, ["doc_id"]).select("doc_id", "rank", "score", "grade")


def _phrase_freq(s: SparkSession, d: str) -> DataFrame:
    return rk.phrase_freq(an.tokens(documents(s, d)), phrases(s))


def _listed(lists: DataFrame) -> DataFrame:
    """Whole lists as text, each entry as doc:tf:positions."""
    entry = lambda p: F.concat_ws(":", p["doc_id"].cast("string"), p["tf"].cast("string"), F.concat_ws(",", F.transform(p["tp"], lambda x: x.cast("string"))))
    return lists.select("term", "ttf", "df", "block", F.concat_ws(" ", F.transform("postings", entry)).alias("postings"))


def _merge(s: SparkSession, d: str) -> DataFrame:
    """The lists of two partial indexes, of the English documents and of all others, merged and sorted anew."""
    english = F.coalesce(F.col("lang") == "en", F.lit(False))
    parts = [ix.nested(ix.postings(an.tokens(table(s, d, "documents").filter(c)), positions=True), LIST_BLOCK) for c in (english, ~english)]
    return _listed(ix.merged_lists(parts, LIST_BLOCK))


def _stats(s: SparkSession, d: str) -> DataFrame:
    return built(s, d).stats().select("n_docs", "total_len", F.round("avgdl", 6).alias("avgdl"), "avgdl_int", "vocabulary")


def _unique(s: SparkSession, d: str) -> DataFrame:
    return ix.postings(an.tokens(documents(s, d))).groupBy("doc_id").agg(F.count(F.lit(1)).alias("unique_terms"))


def _unique_stats(s: SparkSession, d: str) -> DataFrame:
    u = F.col("unique_terms")
    return _unique(s, d).agg(F.count(u).alias("n"), F.min(u).alias("least"), F.max(u).alias("most"), F.round(F.avg(u), 6).alias("mean"), F.sum(u).cast("long").alias("total"))


def _vocab_intersect(s: SparkSession, d: str) -> DataFrame:
    one = lambda lang: an.tokens(table(s, d, "documents").filter(F.col("lang") == lang)).select("term")
    return one("en").intersect(one("fr"))


def _proximity(s: SparkSession, d: str) -> DataFrame:
    return bl.nearest(bl.Parts.build(documents(s, d), positions=True), topic_terms(s, d), px.REACH, rk.DEPTH)


CAT_CTE = "cat as (select * from (values " + ", ".join(f"('{c}', '{t}')" for c, ts in CATEGORIES for t in ts) + ") t(category, term))"
_QUERY = "q1(term) as (values " + ", ".join(f"('{t}')" for t in MARKED) + ")"
_MARK = "|".join(MARKED)
_LAPLACE = "select query_id, doc_id, {s} s from qn cross join docs cross join stats left join (select query_id, doc_id, sum(qtf * {log}(tf + 1)) g from met group by all) using (query_id, doc_id)"

_SPANS = """occ as (select query_id, doc_id, term, pos from q join tokens using (term)), two as (select query_id, doc_id, count(distinct term) n_met from occ group by all having count(distinct term) >= 2),
w as (select a.query_id, a.doc_id, a.pos, b.term, min(b.pos) p from occ a join occ b on a.query_id = b.query_id and a.doc_id = b.doc_id and b.pos >= a.pos group by a.query_id, a.doc_id, a.pos, b.term),
sp as (select query_id, doc_id, n_met, min(wide) span from (select query_id, doc_id, pos, max(p) - pos wide, count(*) c from w group by query_id, doc_id, pos) join two using (query_id, doc_id) where c = n_met group by query_id, doc_id, n_met)"""

def _lists(block: int) -> str:
    return f"with {TOKENS}, pt as (select term, doc_id, count(*) tf, string_agg(pos::varchar, ',' order by pos) tp from tokens group by all), o as (select *, row_number() over (partition by term order by tf desc, doc_id) r, sum(tf) over (partition by term)::bigint ttf, count(*) over (partition by term) df from pt) select term, ttf, df, ((r - 1) // {block})::bigint block, string_agg(doc_id || ':' || tf || ':' || tp, ' ' order by r) postings from o group by all"


QUERIES = {
    "okapi_tf": _ranked("okapi_tf"),
    "tf_idf": _ranked("tf_idf"),
    "tf_idf_log2": _ranked("tf_idf_log2"),
    "bm25": _ranked("bm25"),
    "laplace": _ranked("laplace"),
    "laplace_log2": _ranked("laplace_log2"),
    "jelinek_mercer": _ranked("jelinek_mercer"),
    "jm_constant_bg": _ranked("jm_constant_bg"),
    "run_topk": _ranked("bm25", 10, descending_ids=True),
    "category_bm25": _category_bm25,
    "topic_score": _topic_score,
    "crawl_priority": _crawl_priority,
    "search_highlight": _search_highlight,
    "hits_assessed": _hits_assessed,
    "phrase_freq": _phrase_freq,
    "wildcard_count": lambda s, d: rk.wildcard_counts(documents(s, d), NEEDLE),
    "proximity": _proximity,
    "min_span": lambda s, d: bl.all_spans(bl.Parts.build(documents(s, d), positions=True), topic_terms(s, d)),
    "min_span_greedy": lambda s, d: bl.all_spans(bl.Parts.build(documents(s, d), positions=True), topic_terms(s, d), greedy=True),
    "term_freq": lambda s, d: ix.postings(an.tokens(documents(s, d)), positions=True).select("term", "doc_id", "tf", F.concat_ws(",", "tp").alias("tp")),
    "term_stats": lambda s, d: ix.term_stats(ix.postings(an.tokens(documents(s, d)))),
    "term_lookup": lambda s, d: ix.term_lookup(ix.term_stats(ix.postings(an.tokens(documents(s, d)))), s.createDataFrame([(t,) for t in WANTED], "term string")),
    "doc_length": lambda s, d: ix.doc_lengths(documents(s, d), stop=["the", "of", "a", "in", "and"]),
    "corpus_stats": _stats,
    "unique_terms": _unique,
    "approx_unique_terms": lambda s, d: an.tokens(documents(s, d)).agg(F.approx_count_distinct("term").alias("unique_terms")),
    "doc_unique_stats": _unique_stats,
    "postings_merge": _merge,
    "postings_nested": lambda s, d: _listed(ix.nested(ix.postings(an.tokens(documents(s, d)), positions=True))),
    "stem_terms": lambda s, d: an.stems(an.tokens(documents(s, d))),
    "stemmed_stats": lambda s, d: ix.term_stats(ix.postings(an.stemmed(an.tokens(documents(s, d))))),
    "vocab_intersect": _vocab_intersect,
    "query_split": lambda s, d: table(s, d, "topics").select("query_id", F.concat_ws(" ", an.query_set("topic_text", ["Document", "will", "discuss"])).alias("terms")),
}

ORACLES = {
    "okapi_tf": f"with {SEARCH} " + ranked(f"select query_id, doc_id, sum(qtf * ({OKAPI})) s from met group by all"),
    "tf_idf": f"with {SEARCH} " + ranked(f"select query_id, doc_id, sum(qtf * ({OKAPI}) * ln(n_docs / df)) s from met group by all"),
    "tf_idf_log2": f"with {SEARCH} " + ranked(f"select query_id, doc_id, sum(qtf * ({OKAPI}) * log2(n_docs / df)) s from met group by all"),
    "bm25": f"with {SEARCH} " + ranked(f"select query_id, doc_id, sum(qtf * {BM25}) s from met group by all"),
    "laplace": f"with {SEARCH} " + ranked(_LAPLACE.format(s="coalesce(g, 0) - q_len * ln(dl + vocabulary)", log="ln")),
    "laplace_log2": f"with {SEARCH} " + ranked(_LAPLACE.format(s="coalesce(g, 0) - q_len * log2(dl + vocabulary)", log="log2")),
    "jelinek_mercer": f"with {SEARCH}, base as (select query_id, sum(qtf * ln(0.7 * ttf / total_len)) base from q join terms using (term) cross join stats group by all) "
    + ranked("select query_id, doc_id, base + coalesce(g, 0) s from base cross join docs left join (select query_id, doc_id, sum(qtf * (ln(0.3 * tf / dl + 0.7 * ttf / total_len) - ln(0.7 * ttf / total_len))) g from met group by all) using (query_id, doc_id)"),
    "jm_constant_bg": f"with {SEARCH} "
    + ranked("select query_id, doc_id, q_len * log2(0.5 * total_len / vocabulary) + coalesce(g, 0) s from qn cross join stats cross join docs left join (select query_id, doc_id, sum(qtf * (log2(0.5 * total_len / vocabulary + 0.5 * tf / dl) - log2(0.5 * total_len / vocabulary))) g from met group by all) using (query_id, doc_id)"),
    "run_topk": f"with {SEARCH} " + ranked(f"select query_id, doc_id, sum(qtf * {BM25}) s from met group by all", 10, "doc_id desc"),
    "category_bm25": f"with {INDEX}, {CAT_CTE}, cdf as (select category, max(df) df from cat join terms using (term) group by all), ctf as (select category, doc_id, sum(tf) tf from cat join post using (term) group by all) select doc_id, round(sum({BM25}), 6) score from ctf join cdf using (category) join docs using (doc_id) cross join stats group by all",
    "topic_score": f"with {INDEX}, {CAT_CTE}, ctf as (select category, doc_id, sum(tf) tf from cat join post using (term) group by all) select doc_id, round(sum(tf / (tf + 0.5 + 1.5 * dl / 500.0)), 6) score from ctf join docs using (doc_id) group by all",
    "crawl_priority": f"with documents as (select distinct page_id doc_id, text, crawl_depth from page_text_table where page_id is not null), {INDEX}, {CAT_CTE}, ctf as (select category, doc_id, sum(tf) tf from cat join post using (term) group by all), sc as (select doc_id, sum(tf / (tf + 0.5 + 1.5 * dl / 500.0)) score from ctf join docs using (doc_id) group by all) select doc_id page_id, round(0.8 * score + coalesce(1.0 / (1 + crawl_depth), 0), 6) page_score, round(0.2 * (0.8 * score + coalesce(1.0 / (1 + crawl_depth), 0)), 6) child_score from sc join documents using (doc_id)",
    "search_highlight": f"with {INDEX}, {_QUERY}, met as (select * from q1 join terms using (term) join post using (term) join docs using (doc_id) cross join stats), r as ({ranked(f'select 1 query_id, doc_id, sum({BM25}) s from met group by all', 200)}) select doc_id, rank, score, regexp_replace(text, '(?i)\\b({_MARK})\\b', '<mark>\\1</mark>', 'g') marked, substring(text, 1, 150) snippet from r join documents using (doc_id)",
    "hits_assessed": f"with {INDEX}, {_QUERY}, met as (select * from q1 join terms using (term) join post using (term) join docs using (doc_id) cross join stats), r as ({ranked(f'select 1 query_id, doc_id, sum({BM25}) s from met group by all', 200)}) select doc_id, rank, score, label grade from r left join embeddings on vec_id = doc_id",
    "phrase_freq": f"with {TOKENS}, ph as (select * from (values " + ", ".join(f"({i}, {k}, '{t}', {len(p[0].split())})" for i, p in enumerate(PHRASES) for k, t in enumerate(p[0].split())) + ") t(phrase_id, k, term, len)), b as (select phrase_id, doc_id, pos - k begin_, len, count(*) met from tokens join ph using (term) group by all) select phrase_id, doc_id, count(*) freq from b where met = len group by all",
    "wildcard_count": f"select doc_id, len(regexp_extract_all(lower(text), '{NEEDLE}'))::bigint hits from documents where contains(lower(text), '{NEEDLE}')",
    "proximity": f"with {SEARCH}, {_SPANS} " + ranked("select query_id, doc_id, (1500 - span) * q_len / (dl + vocabulary) s from sp join docs using (doc_id) join qn using (query_id) cross join stats"),
    "min_span": f"with {SEARCH}, {_SPANS} select query_id, doc_id, n_met, span::bigint span from sp",
    "term_freq": f"with {TOKENS} select term, doc_id, count(*) tf, string_agg(pos::varchar, ',' order by pos) tp from tokens group by all",
    "term_stats": f"with {INDEX} select * from terms",
    "term_lookup": f"with {INDEX}, w(term) as (values " + ", ".join(f"('{t}')" for t in WANTED) + ") select term, coalesce(df, 0) df, coalesce(ttf, 0) ttf from w left join terms using (term)",
    "doc_length": f"with {TOKENS} select d.doc_id, coalesce(n, 0)::bigint dl from documents d left join (select doc_id, count(*) n from tokens where term not in ('the', 'of', 'a', 'in', 'and') group by all) using (doc_id)",
    "corpus_stats": f"with {INDEX} select n_docs, total_len, round(avgdl, 6) avgdl, floor(avgdl)::bigint avgdl_int, vocabulary from stats",
    "unique_terms": f"with {INDEX} select doc_id, count(*) unique_terms from post group by all",
    "doc_unique_stats": f"with {INDEX}, u as (select doc_id, count(*) u from post group by all) select count(*) n, min(u) least, max(u) most, round(avg(u), 6) mean, sum(u)::bigint total from u",
    "postings_merge": _lists(LIST_BLOCK),
    "postings_nested": _lists(ix.BLOCK),
    "vocab_intersect": f"with documents as (select * from documents where lang in ('en', 'fr')), {TOKENS} select distinct term from tokens join documents using (doc_id) where lang = 'en' intersect select term from tokens join documents using (doc_id) where lang = 'fr'",
}
