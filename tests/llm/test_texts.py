"""Near-duplicates, term weights, encoding and mixing against brute force."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidemark.llm import p5_near_duplicates as nd
from tidemark.llm.p6_distinctive import term_weights
from tidemark.llm.p7_encode import TOKENIZERS, Encoder, encoded, token_counts, tokenizer_files
from tidemark.llm.p8_mixing import mixed_sources

WORD = re.compile(r"[^\W_]+")


def runs(text, n=3):
    w = WORD.findall((text or "").lower())
    return set(zip(*(w[k:] for k in range(n))))


def brute_pairs(rows, similarity=0.6):
    sets = {i: s for i, t in rows if (s := runs(t))}
    ids = sorted(sets)
    return {(a, b) for x, a in enumerate(ids) for b in ids[x + 1 :] if len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b]) - 1e-12}


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"w{rng.randrange(10**6)}"
    return words


@pytest.fixture(scope="module")
def pages():
    rng = random.Random(7)
    vocabulary = [f"v{i}" for i in range(300)]
    menu = "home news sport weather contact imprint privacy terms of use all rights reserved by the site".split() * 2
    rows, i = [], 0
    for _ in range(60):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([20, 60, 150, 300]))]
        for n in (0, len(base) // 40, len(base) // 15, len(base) // 8):
            i += 1
            rows.append((i, " ".join([*menu, *edited(rng, base, n)])))
    original = [rng.choice(vocabulary) for _ in range(150)]
    rows += [(1000 + k, " ".join(edited(rng, original, 3))) for k in range(90)]  # a widely copied text
    rows += [(2000 + k, " ".join([*menu, f"x{k % 30}"])) for k in range(90)]  # hardly anything but the menu
    return rows


def test_near_duplicates_equal_brute_force(spark, pages):
    df = spark.createDataFrame(pages, "page_id long, text string").withColumn("rep", F.lit("clash")).withColumn("a", F.lit(0))
    got = {tuple(r) for r in nd.expand_pairs(*nd.near_duplicates(df, "page_id", "text")).collect()}
    want = brute_pairs(pages)
    assert got <= want
    assert len(got) >= 0.999 * len(want)


def test_near_duplicate_cases(spark):
    long = "a b c d e f g h " * 20000
    rows = [(1, "one two three four"), (2, "ONE, two; three four!"), (2, "ONE, two; three four!"), (3, "one two"), (4, None), (5, ""), (6, "   "), (None, "one two three four"), (7, "one two three four five"), (8, long), (9, long + "z")]
    df = spark.createDataFrame(rows, "id long, text string")
    member, pairs = nd.near_duplicates(df, "id", "text")
    assert {r.id for r in member.collect()} == {1, 2, 7, 8, 9}
    got = {tuple(r) for r in nd.expand_pairs(member, pairs).collect()}
    assert got == {(1, 2), (1, 7), (2, 7), (8, 9)}
    links = {r.id: (r.rep, r.links) for r in nd.duplicate_classes(member, pairs).collect()}
    assert links[1] == (1, 1) and links[2] == (1, 1) and links[7] == (7, 1)
    none = nd.near_duplicates(df.limit(0), "id", "text")
    assert none[0].count() == 0 and none[1].count() == 0


def test_term_weights_equal_brute_force(spark):
    rng = random.Random(5)
    rows = [("page", i, " ".join(rng.choice("abcdefghij") for _ in range(rng.randrange(30)))) for i in range(40)] + [("email", 1, "x Y x_x"), ("email", 1, "x Y x_x"), ("email", 2, None), ("email", 3, ""), ("page", None, "q")]
    df = spark.createDataFrame(rows, "kind string, record_id long, text string").withColumn("term", F.lit("clash")).withColumn("df", F.lit(1))
    got = {(r.kind, r.record_id, r.term): (r.tf, r.df, r.weight) for r in term_weights(df).collect()}
    docs = {(k, i): WORD.findall((t or "").lower()) for k, i, t in rows if i is not None}
    want = {}
    for kind in ("page", "email"):
        own = {k: w for k, w in docs.items() if k[0] == kind}
        n, avg = len(own), sum(map(len, own.values())) / len(own)
        df_ = Counter(t for w in own.values() for t in set(w))
        for k, w in own.items():
            for t, tf in Counter(w).items():
                idf = math.log(1 + (n - df_[t] + 0.5) / (df_[t] + 0.5))
                want[(*k, t)] = (tf, df_[t], idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(w) / avg)))
    assert set(got) == set(want)
    assert all(got[k][:2] == want[k][:2] and got[k][2] == pytest.approx(want[k][2]) for k in want)
    some = {(r.kind, r.record_id, r.term): (r.tf, r.df, r.weight) for r in term_weights(df, min_tf=3).collect()}
    assert some == {k: v for k, v in got.items() if v[0] >= 3}
    assert term_weights(df.limit(0)).count() == 0


TEXTS = [None, "", " ", "Hello world", "  two  blanks\n\n\ttab", "<|endoftext|> is text", "naïve é 你好 🚢⚓️ ​�", "a" * 3000, "ab" * 2000, "x1y22z333 don't we'll", "Οδός ΑΒΓ", "\r\n\r\n", "unbelievableness" * 40, "0123456789" * 99]


def reference(texts):
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(f"{TOKENIZERS}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def test_encoding_equals_the_tokenizer(spark):
    rng = random.Random(11)
    letters = "abcdefghijklmnopqrstuvwxyz ABC éßλж你🚢'.,-\n0123"
    texts = TEXTS + ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 400))) for _ in range(600)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("ids", F.lit("clash"))
    got = {r.doc_id: r.ids for r in encoded(df).collect()}
    assert [got[i] for i in range(len(texts))] == reference(texts)
    counts = {r.doc_id: r.n_tokens for r in token_counts(df).collect()}
    assert counts == {i: len(x) for i, x in got.items()}
    assert encoded(df.limit(0)).count() == 0


def test_decoding_gives_the_text_back():
    e = Encoder(*tokenizer_files())
    raw = {r: t for t, r in e.rank.items()}
    for text in TEXTS[1:]:
        assert b"".join(raw[i] for i in e.encode_batch([text])[0]) == text.encode()


def test_seams_are_compatible_exactly_when_merging_keeps_them():
    import numpy as np

    e = Encoder(*tokenizer_files())
    raw = {r: t for t, r in e.rank.items()}
    rng = random.Random(2)
    pairs = [(rng.randrange(e.n), rng.randrange(e.n)) for _ in range(3000)] + [(rng.randrange(2000), rng.randrange(2000)) for _ in range(3000)]
    told = e.compatible(np.array([a for a, _ in pairs]), np.array([b for _, b in pairs]))
    wrong = [p for p, ok in zip(pairs, told) if ok != (e._merge_long(raw[p[0]] + raw[p[1]]) == list(p))]
    assert not wrong


def sized(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, source string, n_tokens long").withColumn("copies", F.lit("clash"))


def targets(spark, *rows):
    return spark.createDataFrame(rows, "source string, target_share double, max_repeats int")


def test_mixing_reaches_the_shares(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice([" News ", "news", "NEWS"]), rng.randrange(1, 400)) for i in range(2000)] + [(5000 + i, "log-book", rng.randrange(1, 50)) for i in range(100)] + [(9000, None, 5), (9001, "other", 5), (9002, "news", 0), (9003, "news", None)]
    taken, report = mixed_sources(sized(spark, rows), targets(spark, ("news", 0.9, 1), ("log_book", 0.1, 4), ("absent", 0.0, 1)))
    shares = {r.source: r for r in report.collect()}
    assert shares["news"].actual_share == pytest.approx(0.9, abs=0.01) and shares["log_book"].most_copies == 4
    got = {r.doc_id: r.copies for r in taken.collect()}
    assert not {9000, 9001, 9002, 9003} & set(got) and all(1 <= got[i] <= 4 for i in got)
    again = {r.doc_id: r.copies for r in mixed_sources(sized(spark, rows), targets(spark, ("news", 0.9, 1), ("log_book", 0.1, 4)))[0].collect()}
    assert again == got


def test_mixing_with_a_total_and_without_rows(spark):
    rows = [(i, "a", 10) for i in range(10)] + [(100 + i, "b", 10) for i in range(10)]
    taken, report = mixed_sources(sized(spark, rows), targets(spark, ("a", 0.75, 2), ("b", 0.25, 1)), total=240.0)
    by = {r.source: (r.tokens, r.most_copies) for r in report.collect()}
    assert by == {"a": (180, 2), "b": (60, 1)}
    taken, report = mixed_sources(sized(spark, []), targets(spark, ("a", 1.0, 2)))
    assert taken.count() == 0 and [r.tokens for r in report.collect()] == [0]


def test_near_duplicates_of_much_copied_texts_need_no_more_shared_values(spark):
    """Many copies with many edits: the required overlap does not rise with the length of the lists."""
    rng = random.Random(3)
    pool = [f"w{i}" for i in range(5000)]
    base = rng.choices(pool, k=300)
    texts = []
    for _ in range(150):
        made = list(base)
        for _ in range(rng.randrange(10, 14)):
            made[rng.randrange(300)] = rng.choice(pool)
        texts.append(" ".join(made))
    runs = [nd.shingles(nd.words(t), 3) for t in texts]
    want = {(i, j) for i in range(150) for j in range(i + 1, 150) if len(runs[i] & runs[j]) >= 0.6 * len(runs[i] | runs[j])}
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = {(r.a, r.b) for r in nd.near_duplicates(df, "id", "text")[1].collect()}
    assert got == want


def test_mixing_counts_a_document_once(spark):
    rows = [(i, "a", 10) for i in range(40)] * 2 + [(100 + i, "b", 10) for i in range(45)] + [(1, "b", 10), (None, "a", 10), (None, "b", 10)]
    df = spark.createDataFrame(rows, "doc_id long, source string, n_tokens long")
    targets = spark.createDataFrame([("a", 0.5, 2), ("b", 0.5, 1), ("b", 0.5, 1)], "source string, target_share double, max_repeats int")
    taken, report = mixed_sources(df, targets, total=900.0)
    got = [tuple(r) for r in taken.select("doc_id", "source", "copies").collect()]
    assert len(got) == len({g[:2] for g in got}) and all(g[0] is not None for g in got)
    assert {g[1] for g in got if g[0] == 1} == {"a", "b"}
    by = {r.source: r for r in report.collect()}
    assert by["a"].tokens == 450 and by["b"].tokens == 450 and abs(by["a"].actual_share - 0.5) < 1e-9
    assert by["a"].most_copies <= 2 and by["b"].most_copies == 1


def _near(spark, texts, **options):
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(4)
    return {(r.a, r.b) for r in nd.near_duplicates(df, "id", "text", **options)[1].collect()}


def _all_pairs(texts, similarity=0.6):
    """Brute force by a matrix: each pair's shared runs, of those that any two texts share."""
    import numpy as np

    sets = [runs(t) for t in texts]
    shared = {r: k for k, r in enumerate(r for r, c in Counter(r for s in sets for r in s).items() if c > 1)}
    holds = np.zeros((len(texts), len(shared)), dtype=np.float32)
    for i, s in enumerate(sets):
        holds[i, [shared[r] for r in s if r in shared]] = 1
    both, n = holds @ holds.T, np.array(list(map(len, sets)))
    a, b = np.nonzero(np.triu(both >= similarity * (n[:, None] + n - both) - 1e-9, 1))
    return set(zip(a.tolist(), b.tolist()))


@pytest.mark.parametrize("copies, every", [(40, 12), (80, 12), (80, 13), (80, 14), (200, 13), (1000, 13)])
def test_form_letters_of_any_number_are_found(spark, copies, every):
    """One template in which every so-many-th word is another value: unlike runs of eight words, most of three are shared."""
    rng = random.Random(copies * every)
    template = [f"t{rng.randrange(4000)}" for _ in range(260)]
    texts = [" ".join(f"s{rng.randrange(10**7)}" if i % every == every - 1 else w for i, w in enumerate(template)) for _ in range(copies)]
    want = _all_pairs(texts)
    got = _near(spark, texts)
    assert got <= want and len(got) >= 0.99 * len(want)


def test_long_texts_of_few_distinct_runs_are_compared(spark):
    rng = random.Random(9)
    texts = []
    for p in range(20):
        base = [f"p{p}x{k}" for k in range(rng.randrange(8, 20))]
        texts += [" ".join(base * 12), " ".join(base[:-1] * 12)]
    want = brute_pairs(list(enumerate(texts)))
    assert len(want) > 10 and _near(spark, texts) == want


def test_blocks_give_the_same_pairs(spark, pages):
    texts = [t for _, t in pages]
    assert _near(spark, texts, block=7) == _near(spark, texts)


def test_only_rows_that_pairs_need_are_shuffled(spark):
    """Of 2,000 records 90 are near-duplicates or copies: the sketches of all are shuffled once at most, and the texts never."""
    rng = random.Random(13)
    texts = [" ".join(f"u{rng.randrange(10**6)}" for _ in range(150)) for _ in range(1940)]
    texts += [f"{t} more" for t in texts[:30]] + texts[30:60]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    context = spark.sparkContext._jsc.sc()

    def whole_tables():
        """Stages that shuffled a row for most records, of at least 300 bytes."""
        context.listenerBus().waitUntilEmpty(30_000)
        stages = context.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
        stages = [stages.apply(k) for k in range(stages.size())]
        return {s.stageId() for s in stages if len(texts) / 2 < s.shuffleWriteRecords() <= len(texts) and s.shuffleWriteBytes() > 300 * s.shuffleWriteRecords()}

    before, known = spark.conf.get("spark.sql.autoBroadcastJoinThreshold"), whole_tables()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as if no side were small
    try:
        got = {(r.a, r.b) for r in nd.near_duplicates(df, "id", "text")[1].collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert got == {(i, 1940 + i) for i in range(30)}
    assert len(whole_tables() - known) <= 1


def test_a_full_map_of_ids_keeps_all_that_are_asked_for(spark):
    rows, ids = spark.range(-500, 500), spark.range(-500, 500, 9)
    for most in (64, 128, nd.MAP_BITS):
        got = {r.id for r in nd.thinned(rows, ids, most).collect()}
        assert got >= set(range(-500, 500, 9)) and (len(got) < 250 or most < 1000)
    assert nd.thinned(rows, ids.limit(0)).count() == 0
