"""First ranks from the index in parts, against brute force over all pairs."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from tidemark.operators import blocks as bl
from tidemark.operators import proximity as px
from tidemark.operators import ranking as rk
from tidemark.plans.registry import QUERIES

RANKED = ["bm25", "jelinek_mercer", "tf_idf", "jm_constant_bg", "laplace", "run_topk", "tf_idf_log2", "laplace_log2", "okapi_tf", "proximity", "min_span", "min_span_greedy", "ltr_features", "ltr_page_features"]


def texts(n=1500, seed=5):
    rng = random.Random(seed)
    words = [w for i, w in enumerate("abcdefghij") for _ in range(1 + i * i // 4)]
    return [(rng.randrange(-(10**9), 10**9) * 2000 + i, " ".join(rng.choice(words) for _ in range(rng.randrange(0, 25)))) for i in range(n)]


def parts_of(docs, size):
    """The rows of parts of ``size`` documents."""
    for number, k in enumerate(range(0, len(docs), size)):
        codes = bl._Codes()
        words = [t.split() for _, t in docs[k : k + size]]
        yield bl._part(number, [i for i, _ in docs[k : k + size]], [*map(len, words)], [codes[w] for ws in words for w in ws], codes, True)


def batch_of(docs, queries, size):
    """What a worker reads: the queries (query_id, term, qtf), then the parts' rows."""
    rows = pa.Table.from_batches([*parts_of(docs, size)])
    lists = rows.to_pylist()
    known = {}
    for r in lists:
        df, ttf = known.get(r["term"], (0, 0))
        known[r["term"]] = df + r["n"], ttf + r["ttf"]
    lists = [r for r in lists if r["term"] is None or r["term"] in {t for _, t, _ in queries}]
    head = [{"kind": 0, "term": t, "query_id": q, "qtf": n, "df": known.get(t, (None, None))[0], "ttf": known.get(t, (None, None))[1]} for q, t, n in queries]
    tail = [{"kind": 1, "term": r["term"], "part": r["part"], "n": r["n"], "docs": r["docs"], "tfs": r["tfs"], "tps": r["tps"]} for r in sorted(lists, key=lambda r: (r["part"], r["term"] or ""))]
    kinds = pa.schema([("kind", pa.int32()), ("part", pa.int64()), ("term", pa.string()), ("query_id", pa.int64()), ("qtf", pa.int64()), ("df", pa.int64()), ("ttf", pa.int64()), ("n", pa.int64()), ("docs", pa.binary()), ("tfs", pa.binary()), ("tps", pa.binary())])
    whole = pa.Table.from_pylist(head + tail, schema=kinds)
    of_docs = known.pop(None)
    return whole.to_batches(max_chunksize=7), bl.Stats(of_docs[0], of_docs[1], len(known)), known


def brute(docs, queries, model, stats, known, depth, descending):
    out = {}
    for q in {q for q, *_ in queries}:
        terms = sorted((t, n, *known.get(t, (0, 0))) for p, t, n in queries if p == q)
        base = model.base(*(np.array(x, float) for x in list(zip(*terms))[1:]), stats) if model.base else 0.0
        if base is None:
            continue
        scores = []
        for i, text in docs:
            words = text.split()
            dl, met = np.array([len(words)]), [(n, words.count(t), df, ttf) for t, n, df, ttf in terms if t in words]
            if not met and not model.everywhere:
                continue
            score = sum((n * float(model.weight(np.array([tf]), dl, df, ttf, stats)[0]) for n, tf, df, ttf in met), 0.0) + base
            if model.by_length:
                score -= sum(n for _, n, *_ in terms) * float(model.by_length(dl, stats)[0])
            scores.append((-float(bl.six_places(np.array([score]))[0]), -i if descending else i))
        out[q] = [(k + 1, -i if descending else i, -x) for k, (x, i) in enumerate(sorted(scores)[:depth])]
    return out


@pytest.mark.parametrize("model", sorted(rk.MODELS))
@pytest.mark.parametrize("depth,block,dense", [(3, 10**6, 10**9), (40, 500, 10**9), (40, 700, 0), (5000, 400, 10**5)])
def test_first_ranks_equal_brute_force(monkeypatch, model, depth, block, dense):
    monkeypatch.setattr(bl, "BLOCK", block)
    monkeypatch.setattr(bl, "DENSE", dense)
    docs = texts()
    queries = [(1, "a", 1), (1, "j", 2), (2, "h", 1), (2, "i", 1), (2, "g", 3), (2, "zz", 1), (3, "zz", 2), (4, "a", 1), (5, "b", 1), (5, "c", 1)]
    batches, stats, known = batch_of(docs, queries, 100)
    for descending in (False, True):
        got = {}
        for out in bl._first(iter(batches), rk.MODELS[model], stats, depth, descending, pa.int32()):
            for r in out.to_pylist():
                got.setdefault(r["query_id"], []).append((r["rank"], r["doc_id"], r["score"]))
        want = brute(docs, queries, rk.MODELS[model], stats, known, depth, descending)
        assert {q: [x[:2] for x in v] for q, v in got.items()} == {q: [x[:2] for x in v] for q, v in want.items() if v}
        assert all(abs(a[2] - b[2]) < 1e-9 for q in got for a, b in zip(got[q], want[q]))


def test_parts_count_documents_without_text_and_acronyms(spark):
    docs = spark.createDataFrame([(1, "u.s. ships sank"), (2, "Ships sank near the U.S."), (3, None), (None, "the the"), (5, "")], "doc_id long, text string")
    parts = bl.Parts.build(docs.repartition(2))
    assert parts.stats == bl.Stats(5, 10, 5)
    assert {(r.term, r.df, r.ttf) for r in parts.terms().collect()} == {("u.s.", 2, 2), ("ships", 2, 2), ("sank", 2, 2), ("near", 1, 1), ("the", 2, 3)}
    asked = spark.createDataFrame([(1, "the", 1), (2, "none", 1)], "query_id int, term string, qtf long")
    assert [(r.query_id, r.doc_id, r["rank"]) for r in rk.run_of(parts, asked, "bm25").collect()] == [(1, 2, 1)]
    assert sorted({r.doc_id for r in rk.run_of(parts, asked, "laplace").collect()}) == [1, 2, 3, 5]
    assert rk.run_of(bl.Parts.build(docs.limit(0)), asked, "bm25").count() == 0


@pytest.mark.parametrize("name", RANKED)
def test_no_pair_of_query_and_document_is_a_row(spark, small, name):
    """The run leaves the workers as it is; before, each pair with a match was a row of an aggregate and a window."""
    plan = QUERIES[name](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and not re.search("Window|ObjectHashAggregate", plan)


def test_topics_meet_a_run_that_was_not_made_of_pairs(spark, small):
    plan = QUERIES["topics_and_queries"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Window" not in plan


def brute_spans(docs, queries, span):
    out = {}
    for q in {q for q, *_ in queries}:
        for i, text in docs:
            words = text.split()
            lists = [x for x in ([k for k, w in enumerate(words) if w == t] for t in sorted(t for p, t, _ in queries if p == q)) if x]
            if len(lists) >= 2:
                out[q, i] = len(lists), span(lists)
    return out


ASKED = [(1, "a", 1), (1, "j", 2), (2, "h", 1), (2, "i", 1), (2, "g", 3), (2, "zz", 1), (3, "zz", 2), (4, "a", 1), (5, "b", 1), (5, "c", 1), (6, "d", 1), (6, "e", 1), (6, "f", 1), (6, "g", 1), (6, "h", 1)]


@pytest.mark.parametrize("block,dense", [(10**6, 10**9), (400, 0)])
@pytest.mark.parametrize("greedy", [False, True])
def test_spans_of_blocks_equal_those_of_lists(monkeypatch, greedy, block, dense):
    monkeypatch.setattr(bl, "BLOCK", block)
    monkeypatch.setattr(bl, "DENSE", dense)
    docs = texts()
    batches, _, _ = batch_of(docs, ASKED, 100)
    got = {(r["query_id"], r["doc_id"]): (r["n_met"], r["span"]) for out in bl._all_spans(iter(batches), greedy, pa.int32()) for r in out.to_pylist()}
    assert got == brute_spans(docs, ASKED, px.greedy_span if greedy else px.minimal_span)


@pytest.mark.parametrize("depth,block", [(3, 10**6), (40, 400), (5000, 10**6)])
def test_nearest_equal_brute_force(monkeypatch, depth, block):
    monkeypatch.setattr(bl, "BLOCK", block)
    docs = texts()
    batches, stats, _ = batch_of(docs, ASKED, 100)
    got = {}
    for out in bl._nearest(iter(batches), px.REACH, stats, depth, pa.int32()):
        for r in out.to_pylist():
            got.setdefault(r["query_id"], []).append((r["rank"], r["doc_id"], r["score"]))
    length, sizes, want = {i: len(t.split()) for i, t in docs}, {}, {}
    for q, _, n in ASKED:
        sizes[q] = sizes.get(q, 0) + n
    for (q, i), (_, span) in brute_spans(docs, ASKED, px.minimal_span).items():
        want.setdefault(q, []).append((-float(bl.six_places(np.array([(px.REACH - span) * sizes[q] / (length[i] + stats.vocabulary)]))[0]), i))
    assert got == {q: [(k + 1, i, -x) for k, (x, i) in enumerate(sorted(v)[:depth])] for q, v in want.items()}


@pytest.mark.parametrize("block", [10**6, 400])
def test_features_of_each_match_equal_brute_force(monkeypatch, block):
    from tidemark.operators import ltr

    monkeypatch.setattr(bl, "BLOCK", block)
    docs, sets = texts(), [(q, t, 1) for q, t, _ in ASKED]
    batches, stats, known = batch_of(docs, sets, 100)
    got = {(r["query_id"], r["doc_id"]): r for out in bl._each_match(iter(batches), ltr._of_lists, stats, "doc_id", pa.int32()) for r in out.to_pylist()}
    held, back = {i: t.split() for i, t in docs}, 0.5 * stats.total_len / stats.vocabulary
    seen = 0
    for q in {q for q, *_ in sets}:
        terms = [t for p, t, _ in sets if p == q]
        for i, words in held.items():
            met = [t for t in terms if t in words]
            if not met:
                continue
            seen += 1
            dl = np.array([len(words)])
            weigh = lambda m: sum(float(rk.MODELS[m].weight(np.array([words.count(t)]), dl, *known[t], stats)[0]) for t in met)  # noqa: B023, E731
            want = {"okapi_tf": weigh("okapi_tf"), "tf_idf": weigh("tf_idf_log2"), "bm25": weigh("bm25"), "laplace": weigh("laplace_log2") - len(terms) * np.log2(len(words) + stats.vocabulary)}
            want |= {"jm": sum(np.log2(back + 0.5 * words.count(t) / len(words)) for t in terms), "text_term_appeared_in_query_len": len(met) / len(terms), "doc_len": len(words)}
            assert {c: got[q, i][c] for c in want} == pytest.approx(want, abs=1e-6)
    assert seen == len(got)


def test_page_features_of_parts_equal_those_of_rows(spark):
    from tidemark.operators import ltr

    docs = texts(300)
    pages = spark.createDataFrame([(i, None if k % 7 == 0 else docs[-k - 1][1][:9].upper(), None if k % 11 == 0 else t) for k, (i, t) in enumerate(docs)], "page_id long, title string, text string")
    asked = spark.createDataFrame(ASKED, "query_id int, term string, qtf long")
    got = {(r.query_id, r.page_id): tuple(r)[2:] for r in ltr.page_matches(bl.Parts.build(pages, "page_id", title="title"), asked, "page_id").collect()}
    want = {(r.query_id, r.page_id): tuple(r)[2:] for r in ltr.page_features(pages, asked, "page_id").collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-6) for k in got)
