"""Pages, addresses, messages, features and sources."""

import pytest
from pyspark.sql import functions as F

from tidemark.operators import ltr, topics
from tidemark.operators import mail as ml
from tidemark.operators import web as wb


@pytest.mark.parametrize(
    "url,base,want",
    [
        ("HTTP://Ex.com:80/a/../b/index.html#x", None, "http://ex.com/b/"),
        ("https://ex.com:443", None, "https://ex.com/"),
        ("https://ex.com:80/x", None, "https://ex.com:80/x"),
        ("/rel", "http://ex.org/a/b.html", "http://ex.org/rel"),
        ("//ex.org/p?q=1", "https://a.b/c", "https://ex.org/p"),
        ("c.html", "http://ex.org/a/b.html", "http://ex.org/a/c.html"),
        ("c.html", "http://ex.org", "http://ex.org/c.html"),
        ("http://ex.org/%7Euser//x/./y", None, "http://ex.org/~user/x/y"),
        ("http://ex.org/a+b%zz", None, "http://ex.org/a+b%zz"),
        ("", None, None),
        (None, None, None),
    ],
)
def test_canonical_url(spark, url, base, want):
    df = spark.createDataFrame([(url, base)], "u string, b string")
    got = df.select(wb.canonical_url("u", "b" if base else None).alias("c")).first().c
    assert got == want


def test_html(spark):
    html = '<html><head><title> T </title><style>p{}</style></head><body><script>var a="</p>";</script><p>One &amp; <b>two<p>three<!-- no --><a href="/x">l</a> <A class=y HREF=\'mailto:a@b\'>m</A></body>'
    row = spark.createDataFrame([("u", html), ("v", None)], "url string, html string")
    got = {r.url: r for r in row.select("url", wb.html_text("html").alias("t"), wb.page_title("html").alias("title")).collect()}
    assert got["u"].t == "T One & two three l m" and got["u"].title == "T" and got["v"].title == "N/A"
    links = wb.page_links(row)
    assert [tuple(r) for r in links.collect()] == [("u", 1, "/x"), ("u", 2, "mailto:a@b")]
    assert [r.href for r in wb.wanted_links(links).collect()] == ["/x"]
    blocked = spark.createDataFrame([(".pdf",)], "ext string")
    more = spark.createDataFrame([("/a.PDF?x",), ("/b.html",), ("",)], "href string")
    assert [r.href for r in wb.wanted_links(more, blocked).collect()] == ["/b.html"]


def test_frontier_and_scores(spark):
    rows = spark.createDataFrame([("a", 1, "u1"), ("a", 1, "u2"), ("b", 2, "u3")], "domain string, depth int, url string")
    assert {(r.url, r.turn) for r in wb.round_robin(rows).collect()} == {("u1", 1), ("u2", 2), ("u3", 1)}
    scores = spark.createDataFrame([(1, 3.0), (2, 2.0), (3, 2.0), (4, 1.0)], "id int, score double")
    assert {r.id for r in wb.kth_score(scores, 2).collect()} == {1, 2, 3}
    assert wb.kth_score(scores, 9).count() == 4


def test_merge_and_upsert(spark):
    a = spark.createDataFrame([("u", ["x"], "me")], "url string, in_links array<string>, author string")
    b = spark.createDataFrame([("u", ["y", "x"], "you"), ("v", ["z"], None)], a.schema)
    got = {r.url: (r.in_links, r.author) for r in wb.merge_pages(a, b).collect()}
    assert got == {"u": (["x", "y"], "me you"), "v": (["z"], "")}
    rows = spark.createDataFrame([(1, 1, "old"), (1, 2, "new"), (2, 1, "only")], "k int, t int, v string")
    assert {(r.k, r.v) for r in wb.latest(rows, ["k"], "t").collect()} == {(1, "new"), (2, "only")}


MESSAGE = b"""From: Alpha <a@one.example>
Reply-To: <b@two.example>
Bcc: c@three.example
Subject: \xce\xb1 offer
Message-ID: <1@other.example>
Received: from x; Mon, 2 Jan 2006 00:00:05 +0000
Received: from y; Sun, 1 Jan 2006 23:59:55 +0000
MIME-Version: 1.0
Content-Type: multipart/alternative; boundary="b"

--b
Content-Type: text/plain

plain text
--b
Content-Type: text/html

<p>rich <b>text</b></p>
--b--
"""


def test_mime_and_flags(spark):
    files = spark.createDataFrame([("f", bytearray(MESSAGE)), ("g", None)], "path string, content binary")
    parsed = {r.path: r for r in ml.parse_mime(files).collect()}
    assert parsed["f"].text.split() == ["plain", "text", "rich", "text"] and len(parsed["f"].received) == 2
    flags = ml.header_flags(ml.parse_mime(files).filter("path = 'f'")).first()
    assert (flags.weird_addr, flags.weird_sbj, flags.weird_target, flags.weird_content, flags.weird_msg_id, flags.weird_char) == (1, 1, 1, 0, 1, 0)
    assert ml.header_flags(ml.parse_mime(files).filter("path = 'g'"), compat=True).first().weird_sbj == 0


def test_received_span(spark):
    heads = spark.createDataFrame([("x; Mon, 2 Jan 2006 00:00:05 +0000", "y; Sun, 1 Jan 2006 23:59:55 +0000"), ("none", None)], "late string, early string")
    rows = heads.select(*ml.span(ml.received_time("early"), ml.received_time("late"))).collect()
    assert tuple(rows[0]) == (10, 0) and rows[1].span_time is None
    row = heads.limit(1).select(*ml.span(ml.received_time("late"), ml.received_time("early"))).first()
    assert tuple(row) == (86390, 1)


def test_addresses_and_cleaning(spark):
    row = spark.createDataFrame([("Al <A@x.Y>", "a, b-c $5 100% it's")], "h string, t string").select(ml.address("h").alias("a"), ml.clean_text("t").alias("c")).first()
    assert tuple(row) == ("a@x.y", "a b c $5 100% it's")


def test_dictionary_words_keep_their_order(spark):
    rows = spark.createDataFrame([(1, "b-c A x A"), (2, "x"), (3, None), (4, "")], "id int, text string").withColumn("word", F.lit("clash"))
    known = spark.createDataFrame([("b-c",), ("A",), ("A",), (None,)], "word string")
    assert {r.id: r.text for r in ml.dictionary_words(rows, known, "id").collect()} == {1: "b-c a a", 2: "", 3: None, 4: ""}


def test_named_zones_and_chosen_headers(spark):
    rows = spark.createDataFrame([(["by b; Mon, 2 Jan 2006 17:05:05 EST", "by a; Mon, 2 Jan 2006 15:04:05 -0700"],), (["x; 2 Jan 2006 0:00:01 XYZ"],), ([],), (None,)], "received array<string>")
    got = [(r.servers_count, r.span_time, r.wrong_time) for r in ml.chosen_headers(rows).collect()]
    assert got == [(2, 60, 0), (1, None, 0), (0, None, 0), (0, None, 0)]


def test_stratified_split_takes_the_floor_of_each_label(spark):
    rows = spark.createDataFrame([(i, i % 3 == 0) for i in range(100)], "id int, spam boolean")
    got = ml.stratified_split(rows, "spam", "id").filter("part = 'test'").groupBy("spam").count()
    assert {tuple(r) for r in got.collect()} == {(True, 6), (False, 13)}


def test_vocabulary_is_dense_and_ordered(spark):
    v = ml.vocabulary(spark.createDataFrame([("b",), ("a",), ("c",), ("a",)], "term string"))
    assert {tuple(r) for r in v.collect()} == {("a", 0), ("b", 1), ("c", 2)}


def test_normalization_guards_constants_and_unknowns(spark):
    rows = spark.createDataFrame([(1, 1.0, 5.0), (1, 3.0, 5.0), (1, float("nan"), 5.0), (2, float("-inf"), None)], "query_id int, x double, y double")
    got = [(r.query_id, r.x, r.y) for r in ltr.normalized(rows, ["x", "y"]).collect()]
    assert sorted(got) == [(1, -1.0, 0.0), (1, 0.0, 0.0), (1, 1.0, 0.0), (2, 0.0, 0.0)]


def test_models_learn_a_simple_order(spark):
    rows = spark.createDataFrame([(q, f"d{i}", float(i), float(-i), 1.0 if i > 5 else 0.0) for q in range(4) for i in range(10)], "query_id int, doc_id string, u double, v double, label double")
    linear = ltr.fit_linear(rows, ["u", "v"]).transform(rows)
    svm = ltr.scored_by_svm(ltr.fit_rank_svm(rows, ["u", "v"], buckets=4), rows, ["u", "v"])
    for scored in (linear, svm):
        by = {r.doc_id: r.score for r in scored.filter("query_id = 1").collect()}
        assert by["d9"] > by["d1"]


def test_probabilities_and_top_topics(spark):
    df = spark.createDataFrame([([1.0, 3.0, 2.0],), ([2.0, 2.0],)], "x array<double>")
    got = [r.p for r in df.select(topics.as_probabilities("x").alias("p")).collect()]
    assert got == [[0.0, pytest.approx(2 / 3), pytest.approx(1 / 3)], [0.5, 0.5]]
    best = df.select(topics.top_topics("x", 2).alias("t")).first().t
    assert [(b.topic, b.weight) for b in best] == [(1, 3.0), (2, 2.0)]


def test_term_counts(spark):
    rows = spark.createDataFrame([(1, "aa bb aa"), (2, "aa cc"), (3, "bb x"), (4, None)], "doc_id int, text string")
    assert {tuple(r) for r in topics.term_counts(rows).collect()} == {(1, "aa", 2), (1, "bb", 1), (2, "aa", 1), (3, "bb", 1)}
