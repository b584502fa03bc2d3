"""Analysis, index and ranking on three hand-made documents."""

import inspect
import math
import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions.porter2 import stem
from tidemark.operators import analysis as an
from tidemark.operators import index as ix
from tidemark.operators import proximity as px
from tidemark.operators import ranking as rk
from tidemark.operators.order import placed

DOCS = [(1, "u.s. ships sank"), (2, "Ships sank near the U.S."), (3, "the the the"), (4, None), (5, "")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, "doc_id long, text string")


@pytest.fixture(scope="module")
def index(docs):
    return ix.Index.build(docs, positions=True)


def queries(spark, *rows):
    return spark.createDataFrame(rows, "query_id int, term string, qtf long")


def test_tokens_keep_acronyms_and_positions(docs):
    got = [(r.doc_id, r.pos, r.term) for r in an.tokens(docs).orderBy("doc_id", "pos").collect()]
    assert got[:3] == [(1, 1, "u.s."), (1, 2, "ships"), (1, 3, "sank")]
    assert (2, 5, "u.s.") in got and len(got) == 11


def test_other_tokenizers(spark):
    row = spark.createDataFrame([("Ünder-score a_b  Café x.y",)], "t string").select(an.crawl_terms("t").alias("c"), an.split_terms("t").alias("s"), an.folded_terms("t").alias("f"), an.word_pairs("t").alias("w")).first()
    assert "a_b" in row.c and row.s == ["ünder-score", "a_b", "café", "x.y"]
    assert row.f == ["under-score", "a_b", "cafe", "x.y"] and "café" in row.w
    row = spark.createDataFrame([("The (U.S. ships, U.S. sank",)], "t string").select(an.query_set("t", ["The"]).alias("q")).first()
    assert "U.S." in row.q and "ships" in row.q and "The" not in row.q


def test_statistics(index):
    stats = index.stats().first()
    assert (stats.n_docs, stats.total_len, stats.vocabulary) == (5, 11, 5)
    assert {(r.term, r.df, r.ttf) for r in index.terms.collect()} == {("u.s.", 2, 2), ("ships", 2, 2), ("sank", 2, 2), ("near", 1, 1), ("the", 2, 4)}
    assert {(r.doc_id, r.dl) for r in index.docs.collect()} == {(1, 3), (2, 5), (3, 3), (4, 0), (5, 0)}


def test_lengths_without_stop_words_and_lookup(spark, docs, index):
    assert {(r.doc_id, r.dl) for r in ix.doc_lengths(docs, stop=["the"]).collect()} == {(1, 3), (2, 4), (3, 0), (4, 0), (5, 0)}
    found = ix.term_lookup(index.terms, spark.createDataFrame([("the",), ("none",)], "term string"))
    assert {tuple(r) for r in found.collect()} == {("the", 2, 4), ("none", 0, 0)}


def test_merge_is_index_of_union(docs, index):
    parts = [ix.postings(an.tokens(docs.filter(c))) for c in ("doc_id <= 2", "doc_id > 2")]
    assert {tuple(r) for r in ix.term_stats(ix.merged(*parts)).collect()} == {tuple(r) for r in index.terms.collect()}


def test_nested_lists_by_falling_frequency(index):
    row = {r.term: r for r in ix.nested(index.postings).collect()}["the"]
    assert [(p.doc_id, p.tf, p.tp) for p in row.postings] == [(3, 3, [1, 2, 3]), (2, 1, [4])]


def test_lists_are_cut_into_blocks_and_merged(spark, docs, index):
    posts = ix.postings(an.tokens(docs), positions=True)
    whole = ix.nested(posts, 1)
    assert [(r.block, r.postings[0].doc_id, r.df) for r in whole.filter("term = 'the'").orderBy("block").collect()] == [(0, 3, 2), (1, 2, 2)]
    parts = [ix.nested(ix.postings(an.tokens(docs.filter(c)), positions=True)) for c in ("doc_id <= 2", "doc_id > 2")]
    key = lambda df: sorted(map(str, df.collect()))
    assert key(ix.merged_lists(parts)) == key(ix.nested(posts))
    assert ix.nested(posts.limit(0)).count() == 0


def test_places_in_groups(spark):
    rows = [(g, v) for g in (1, 1, 1, 2, None) for v in range(50)]
    df = spark.createDataFrame([(g, v, i) for i, (g, v) in enumerate(rows)], "g int, v int, i int")
    got = {r.i: r.place for r in placed(df, ["g"], [-F.col("v"), F.col("i")]).collect()}
    want = {}
    for g in (1, 2, None):
        for k, (_, i) in enumerate(sorted((-v, i) for i, (h, v) in enumerate(rows) if h == g)):
            want[i] = k + 1
    assert got == want


def test_bm25_by_hand(spark, index):
    got = {r.doc_id: r.score for r in rk.bm25_scores(index, queries(spark, (1, "ships", 1), (1, "absent", 1))).collect()}
    idf = math.log(5.5 / 2.5)
    want = {d: 2.2 / (1 + 1.2 * (0.25 + 0.75 * dl / 2.2)) * idf for d, dl in ((1, 3), (2, 5))}
    assert got == pytest.approx(want)


@pytest.mark.parametrize("model", ["laplace", "jm", "constant"])
def test_smoothed_models_equal_brute_force_over_all_documents(spark, index, model):
    q = queries(spark, (1, "ships", 1), (1, "the", 2), (1, "absent", 1))
    scorer = {"laplace": rk.laplace, "jm": rk.jelinek_mercer, "constant": rk.jelinek_mercer_constant}[model]
    got = {r.doc_id: r.score for r in scorer(index, q).collect()}
    tf = {1: {"ships": 1}, 2: {"ships": 1, "the": 1}, 3: {"the": 3}, 4: {}, 5: {}}
    dl, ttf = {1: 3, 2: 5, 3: 3, 4: 0, 5: 0}, {"ships": 2, "the": 4}
    share = lambda d, t: tf[d].get(t, 0) / dl[d] if dl[d] else 0
    for d in tf:
        if model == "laplace":
            want = sum(n * math.log(tf[d].get(t, 0) + 1) for t, n in (("ships", 1), ("the", 2))) - 4 * math.log(dl[d] + 5)
        elif model == "jm":
            want = sum(n * math.log(0.3 * share(d, t) + 0.7 * ttf[t] / 11) for t, n in (("ships", 1), ("the", 2)))
        else:
            want = sum(n * math.log2(0.5 * share(d, t) + 0.5 * 11 / 5) for t, n in (("ships", 1), ("the", 2), ("absent", 1)))
        assert got[d] == pytest.approx(want)


def test_shallow_depth_gives_the_same_first_ranks(spark, index):
    q = queries(spark, (1, "ships", 1))
    deep, shallow = (rk.top(rk.laplace(index, q, depth=n), 2).collect() for n in (100, 2))
    assert deep == shallow


def test_top_breaks_ties_by_id(spark):
    s = spark.createDataFrame([(1, 9, 0.5), (1, 3, 0.5), (1, 4, 0.7)], "query_id int, doc_id long, score double")
    assert [r.doc_id for r in rk.top(s, 2).orderBy("rank").collect()] == [4, 3]
    assert [r.doc_id for r in rk.top(s, 3, descending_ids=True).orderBy("rank").collect()] == [4, 9, 3]


def test_phrases(spark, docs):
    phrases = spark.createDataFrame([(0, ["ships", "sank"]), (1, ["the", "the"]), (2, ["sank", "ships"])], "phrase_id int, words array<string>")
    got = {tuple(r) for r in rk.phrase_freq(an.tokens(docs), phrases).collect()}
    assert got == {(0, 1, 1), (0, 2, 1), (1, 3, 2)}


def test_highlight_and_wildcard(spark, docs):
    row = docs.filter("doc_id = 2").select(rk.highlighted(F.col("text"), ["ships"]).alias("m")).first()
    assert row.m == "<mark>Ships</mark> sank near the U.S."
    assert [tuple(r) for r in rk.wildcard_counts(docs, "he ").collect()] == [(2, 1), (3, 2)]


def test_spans():
    assert px.minimal_span([[1, 10], [4, 11], [12]]) == 2
    assert px.minimal_span([[3], [3]]) == 0
    assert px.greedy_span([[1, 50], [40, 49]]) == 1


def test_spans_equal_the_heap_over_lists(spark):
    rng = random.Random(3)
    texts = [(i, " ".join(rng.choice("abcdefg") for _ in range(rng.randrange(0, 40)))) for i in range(120)]
    asked = queries(spark, (1, "a", 1), (1, "b", 2), (2, "c", 1), (2, "d", 1), (2, "e", 1), (2, "zz", 1), (3, "f", 1))
    got = {(r.query_id, r.doc_id): (r.n_met, r.span) for r in px.spans(an.tokens(spark.createDataFrame(texts, "doc_id long, text string")), asked).collect()}
    want = {}
    for q, terms in ((1, "ab"), (2, "cde"), (3, "f")):
        for i, text in texts:
            lists = [[k for k, w in enumerate(text.split()) if w == t] for t in terms]
            lists = [x for x in lists if x]
            if len(lists) >= 2:
                want[q, i] = (len(lists), px.minimal_span(lists))
    assert got == want


def test_proximity(spark, docs, index):
    got = {r.doc_id: r.score for r in px.proximity(index, an.tokens(docs), queries(spark, (1, "ships", 1), (1, "near", 1))).collect()}
    assert got == pytest.approx({2: (1500 - 2) * 2 / (5 + 5)})


def test_categories(spark, index):
    cats = spark.createDataFrame([("a", "ships"), ("a", "sank"), ("b", "near")], "category string, term string")
    got = {r.doc_id: r.score for r in rk.topic_scores(index.postings, index.docs, cats).collect()}
    assert got[1] == pytest.approx(2 / (2 + 0.5 + 1.5 * 3 / 500))
    assert set(got) == {1, 2}


@pytest.mark.parametrize("word,want", [("consistency", "consist"), ("knightly", "knight"), ("ships", "ship"), ("skies", "sky"), ("dying", "die"), ("hopping", "hop"), ("hoping", "hope"), ("generously", "generous"), ("communism", "communism"), ("relational", "relat"), ("happy", "happi"), ("by", "by"), ("yellow", "yellow"), ("ties", "tie"), ("cries", "cri"), ("agreed", "agre"), ("controll", "control"), ("succeeding", "succeed")])
def test_porter2(word, want):
    assert stem(word) == want


def test_stems_are_taken_of_distinct_terms(spark, docs):
    got = {r.term: r.stem for r in an.stems(an.tokens(docs)).collect()}
    assert got["ships"] == "ship" and len(got) == 5


def test_index_round_trip(spark, index, tmp_path):
    index.save(str(tmp_path), buckets=2)
    again = ix.Index.load(spark, str(tmp_path))
    assert again.stats().first() == index.stats().first()


def test_empty_collection(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert rk.bm25_scores(ix.Index.build(none), queries(spark, (1, "x", 1))).count() == 0


def test_topic_queries_take_the_surveyed_sizes(spark, small, monkeypatch):
    from tidemark.operators import topics as tp
    from tidemark.plans import topics as plans

    seen = {}

    def noting(name):
        made = getattr(tp, name)

        def run(*args, **kwargs):
            bound = inspect.signature(made).bind(*args, **kwargs)
            bound.apply_defaults()
            seen[name] = {k: bound.arguments[k] for k in ("size", "k", "iterations", "starts") if k in bound.arguments}
            return made(*args, **kwargs)

        monkeypatch.setattr(tp, name, run)

    for name in ("count_pipeline", "fit_lda", "best_kmeans"):
        noting(name)
    assert plans.QUERIES["lda_topics_200"](spark, small).select("topic").distinct().count() == 200
    assert seen == {"count_pipeline": {"size": 1 << 16}, "fit_lda": {"k": 200, "iterations": 20}}
    plans.QUERIES["kmeans_pair_eval"](spark, small).collect()
    assert seen["best_kmeans"] == {"k": 10, "starts": 20}
