"""Pages: the page table as HTML, its text, titles, links and addresses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import web as wb
from tidemark.plans.ctes import HTML
from tidemark.sources.tables import table


def pages(s: SparkSession, d: str) -> DataFrame:
    """Pages once each, with the address and text wrapped as HTML."""
    rows = table(s, d, "page_text_table").filter("page_id is not null").select("page_id", "url", "title", "text").distinct()
    title, url = F.coalesce("title", F.lit("")), F.coalesce("url", F.lit("/"))
    body = F.replace("text", F.lit("\n"), F.lit("</p>\n<p>"))
    parts = [F.lit("<html><head><title>"), title, F.lit('</title><style>p { margin: 0 }</style></head><body><script>var a = "</p>";</script><h1>'), title, F.lit("</h1><p>"), body, F.lit('</p><a href="'), url, F.lit('">here</a> &amp; <a class="x" href="/archive/">there</a></body></html>')]
    return rows.select("page_id", "url", F.concat(*parts).alias("html"))


def _frontier(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "page_text_table").select("url", "crawl_depth").filter("url is not null").select(wb.host("url").alias("domain"), F.col("crawl_depth").alias("depth"), "url").filter("domain is not null").distinct()
    return wb.round_robin(rows)


def _links(s: SparkSession, d: str) -> DataFrame:
    found = wb.page_links(pages(s, d), "page_id").withColumnRenamed("src", "page_id")
    return wb.wanted_links(found, s.createDataFrame([(".html",)], "ext string"))


def _kth(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "training_features").select("row_id", "okapi_tf").filter("okapi_tf is not null and not isnan(okapi_tf)")
    return wb.kth_score(rows, 500, "okapi_tf")


def _merge(s: SparkSession, d: str) -> DataFrame:
    """Two crawls of one host table: by page and by depth."""
    rows = table(s, d, "page_text_table").filter("url is not null").select(wb.host("url").alias("url"), "page_id", "crawl_depth").filter("url is not null").distinct()
    side = lambda c, name: rows.filter(c).groupBy("url").agg(F.collect_set(F.col("page_id").cast("string")).alias("in_links"), F.lit(name).alias("author"))
    out = wb.merge_pages(side("crawl_depth <= 2", "one"), side("crawl_depth >= 2", "two"))
    return out.select("url", F.concat_ws(",", "in_links").alias("in_links"), "author")


def _upsert(s: SparkSession, d: str) -> DataFrame:
    """Latest event of each user and kind: a grade set again replaces the earlier one."""
    rows = table(s, d, "events").select("user_id", "event_type", "event_id", "value")
    return wb.latest(rows, ["user_id", "event_type"], "event_id")


def _span_time(s: SparkSession, d: str) -> DataFrame:
    from pyspark.sql.window import Window

    from tidemark.operators.mail import span

    rows = table(s, d, "events").select("event_id", "user_id", "ts")
    before = F.lag("ts").over(Window.partitionBy("user_id").orderBy("event_id"))
    return rows.withColumn("before", before).filter("before is not null").select("event_id", *span(F.date_trunc("second", "before"), F.date_trunc("second", "ts")))


def _types() -> Column:
    return F.when(F.col("page_id") % 3 == 0, "text/html; charset=utf-8").when(F.col("page_id") % 3 == 1, " Text/plain").when(F.col("page_id") % 5 == 0, F.lit(None)).otherwise("application/x-text/")


def _lengths(s: SparkSession, d: str) -> DataFrame:
    from tidemark.operators.analysis import index_terms

    rows = table(s, d, "page_text_table").filter("page_id is not null and crawl_depth is not null").select("page_id", "crawl_depth", "text").distinct()
    return rows.select("crawl_depth", F.greatest(F.size(index_terms("text")), F.lit(0)).alias("dl"))


def _labelled(s: SparkSession, d: str) -> DataFrame:
    """Labels joined with the texts that are there; others are skipped."""
    labels = table(s, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "label")
    return wb.with_text(labels, table(s, d, "documents").select("doc_id", "text"), "doc_id").select("doc_id", "label", F.length("text").alias("length"))


QUERIES = {
    "text_responses": lambda s, d: wb.text_responses(table(s, d, "page_text_table").select("page_id", _types().alias("content_type")).distinct()),
    "score_above": lambda s, d: wb.above(table(s, d, "training_features").select("row_id", "okapi_tf"), 0.6, "okapi_tf"),
    "running_mean_length": lambda s, d: wb.running_means(_lengths(s, d), "crawl_depth", "dl").withColumn("mean", F.round("mean", 6)),
    "labelled_texts": _labelled,
    "html_text": lambda s, d: pages(s, d).select("page_id", wb.html_text("html").alias("text")),
    "page_title": lambda s, d: pages(s, d).select("page_id", wb.page_title("html").alias("title")),
    "page_links": lambda s, d: wb.page_links(pages(s, d), "page_id").withColumnRenamed("src", "page_id"),
    "wanted_links": _links,
    "canon_url": lambda s, d: table(s, d, "page_text_table").filter("url is not null").select("url", wb.canonical_url("url").alias("canonical")).distinct(),
    "round_robin_frontier": _frontier,
    "kth_score": _kth,
    "merge_pages": _merge,
    "assessment_upsert": _upsert,
    "span_time": _span_time,
}

_TEXT = "regexp_replace(regexp_replace(regexp_replace(html, '<(script|style)\\b.*?</(script|style)\\s*>', ' ', 'gsi'), '<!--.*?-->', ' ', 'gs'), '<[^>]*>', ' ', 'gs')"
for _entity, _plain in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")):
    _TEXT = f"replace({_TEXT}, '{_entity}', '{_plain}')"
_HOST = "nullif(regexp_extract(lower(url), '^[a-z][a-z0-9+.\\-]*://([^/?#@]*@)?([^/?#:]*)', 2), '')"
_CANON = """
u0 as (select distinct url, regexp_replace(trim(url), '[?#].*$', '') x from page_text_table where url is not null),
u1 as (select url, lower(regexp_extract(x, '^([^:]*)://', 1)) sc, lower(regexp_extract(x, '^[^:]*://([^/]*)', 1)) h, regexp_extract(x, '^[^:]*://[^/]*(/.*)?$', 1) p from u0),
u2 as (select url, sc, case when sc = 'http' then regexp_replace(h, ':80$', '') when sc = 'https' then regexp_replace(h, ':443$', '') else h end h, regexp_replace(regexp_replace(case when regexp_matches(p, '%[0-9A-Fa-f]{2}') then url_decode(p) else p end, '/(\\.{0,2}/)+', '/', 'g'), '/index\\.html?$', '/', 'i') p from u1)"""

ORACLES = {
    "text_responses": "select distinct page_id, case when page_id % 3 = 0 then 'text/html; charset=utf-8' else ' Text/plain' end content_type from page_text_table where page_id % 3 < 2",
    "score_above": "select row_id, okapi_tf from training_features where okapi_tf >= 0.6 and not isnan(okapi_tf)",
    "running_mean_length": "with p as (select distinct page_id, crawl_depth, text from page_text_table where page_id is not null and crawl_depth is not null), w as (select crawl_depth, count(*) c, sum(coalesce(len(regexp_extract_all(lower(text), '([a-z0-9]+\\.)*[a-z0-9]+')), 0)) t from p group by all) select crawl_depth, (sum(c) over (order by crawl_depth))::bigint n, round(sum(t) over (order by crawl_depth) / sum(c) over (order by crawl_depth), 6) mean from w",
    "labelled_texts": "select doc_id, label, length(text) length from embeddings join documents on vec_id = doc_id where text is not null",
    "html_text": f"with {HTML} select page_id, regexp_replace(regexp_replace({_TEXT}, '\\s+', ' ', 'g'), '^ | $', '', 'g') as text from html",
    "page_title": f"with {HTML} select page_id, case when html is null or trim(regexp_extract(html, '<title[^>]*>(.*?)</title>', 1, 'is')) = '' then 'N/A' else trim(regexp_extract(html, '<title[^>]*>(.*?)</title>', 1, 'is')) end title from html",
    "page_links": f"with {HTML}, l as (select page_id, regexp_extract_all(html, '<a\\s[^>]*?href\\s*=\\s*[\"'']([^\"'']*)[\"'']', 1, 'i') l from html) select page_id, generate_subscripts(l, 1)::int pos, unnest(l) href from l",
    "wanted_links": f"with {HTML}, l as (select page_id, regexp_extract_all(html, '<a\\s[^>]*?href\\s*=\\s*[\"'']([^\"'']*)[\"'']', 1, 'i') l from html), x as (select page_id, generate_subscripts(l, 1)::int pos, unnest(l) href from l) select * from x where trim(href) <> '' and not regexp_matches(lower(href), '^(javascript|mailto|ftp|tel|data):') and lower(regexp_extract(regexp_replace(href, '[?#].*$', ''), '(\\.[A-Za-z0-9]+)$', 1)) <> '.html'",
    "canon_url": f"with {_CANON} select url, sc || '://' || h || case when p = '' then '/' else p end canonical from u2",
    "round_robin_frontier": f"with f as (select distinct {_HOST} as domain, crawl_depth depth, url from page_text_table where {_HOST} is not null) select *, row_number() over (partition by domain order by depth nulls first, url) turn from f",
    "kth_score": "with x as (select row_id, okapi_tf from training_features where okapi_tf is not null and not isnan(okapi_tf)), k as (select min(okapi_tf) m, count(*) n from (select okapi_tf from x order by okapi_tf desc limit 500)) select row_id, okapi_tf from x, k where n < 500 or okapi_tf >= m",
    "merge_pages": f"with r as (select distinct {_HOST} url, page_id, crawl_depth from page_text_table where {_HOST} is not null), a as (select url, list(distinct page_id::varchar) l from r where crawl_depth <= 2 group by all), b as (select url, list(distinct page_id::varchar) l from r where crawl_depth >= 2 group by all) select url, array_to_string(list_sort(list_distinct(list_concat(coalesce(a.l, []), coalesce(b.l, [])))), ',') in_links, concat_ws(' ', case when a.l is not null then 'one' end, case when b.l is not null then 'two' end) author from a full join b using (url)",
    "assessment_upsert": "select user_id, event_type, event_id, value from (select *, row_number() over (partition by user_id, event_type order by event_id desc) r from events) where r = 1",
    "span_time": "with x as (select event_id, date_trunc('second', ts) t, date_trunc('second', lag(ts) over (partition by user_id order by event_id)) b from events) select event_id, (((epoch(t) - epoch(b))::bigint % 86400 + 86400) % 86400)::bigint span_time, case when t < b then 1 else 0 end wrong_time from x where b is not null",
}
