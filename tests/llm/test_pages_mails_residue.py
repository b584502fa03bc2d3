"""Main bodies, new text of mails and template residue on hand-made cases."""

import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidemark.llm import p9_residue as rs
from tidemark.llm.p2_boilerplate import main_body
from tidemark.llm.p3_mail_text import marked, new_text

PARA = "The committee of the harbour met on Monday and approved the plan. It will be carried out in the spring near the old wharf."


def page(i, host, indent="", extra=""):
    lines = [f"{indent}Quiet Gazette", f"{indent}Home | News | Sport", f"{indent}Home › News › The ship number {i}", f"The ship number {i} left the harbour today", f"{PARA} Number {i}.", "", "Advertisement", f"The cookie tins of ship {i} were opened and counted by the crew.", f"- item {i} of the list was sold", f"{indent}Strange column label of this host", f"{indent}Other story about a boat {i * 7}", f"{indent}Other story about a dock {i * 11}", f"{indent}The gazette of the coast since many years.", f"{indent}Imprint | Privacy", f"{indent}© 2014 Quiet Gazette"]
    return (i, f"http://www.{host}/a/{i}", f"The ship number {i} left the harbour today", "\n".join(lines) + extra)


def test_main_body(spark):
    rows = [page(i, "gazette.example", "  ") for i in range(1, 30)] + [page(40, "single.example")] + [(50, None, None, None), (51, "http://x.example/", "N/A", "   "), (52, None, "t", ""), (None, "http://x.example/", "t", "a b c d e f.")]
    rows += [(60, "http://list.example/", "List", "Home | News | Sport\n" + "\n".join(f"Officials in Port {i} opened the new dock" for i in range(9)) + "\nImprint | Privacy")]
    rows.append(rows[0])
    df = spark.createDataFrame(rows, "page_id long, url string, title string, text string").withColumn("host", F.lit("clash")).withColumn("keys", F.lit(1))
    got: dict[int, set[int]] = {}
    found = main_body(df).collect()
    for r in found:
        got.setdefault(r.page_id, set()).add(r.line_no)
    assert len(found) == sum(map(len, got.values()))
    assert all(got[i] == {4, 5, 8, 9} for i in range(1, 30))
    assert not {50, 51, 52, 60} & set(got)
    assert {4, 5, 8, 9} <= got[40] and not {1, 2, 3, 7, 14, 15} & got[40]
    assert main_body(df.limit(0)).count() == 0


def lines_of(text, sender=None):
    return [i + 1 for i, x in enumerate(marked(text, sender)) if x]


@pytest.mark.parametrize(
    "text,want",
    [
        ("Hi,\n\nnew words here.\n\nKind regards\nAnn", [1, 3]),
        ("On Mon, 1 Jan 2014 at 10:00, Ann <a@b.example> wrote:\n> old words\n> more\n\nNew answer.\n\n> older\n\nSecond answer.", [5, 9]),
        ("Answer.\n\n-----Original Message-----\nFrom: Ann\nSent: Monday\nTo: Bob\nSubject: x\n\nold text", [1]),
        ("Answer.\r\n\r\nFrom: Ann [mailto:a@b.example]\r\nSent: Mon 1 Jan 2014\r\nTo: Bob\r\n\r\nold", [1]),
        ("The From: line is wrong, as Bob wrote:\nit names another ship.", [1, 2]),
        ("Best regards from Ann, who signed the papers today. She left.", [1]),
        ("Text of mine.\n\n-- \nAnn Smith\nTel. 555-0100", [1]),
        ("Text of mine.\n\nPS: one more thing.\n\nThanks,\nAnn", [1, 3]),
        ("Text.\n\n_____________________________________________\nship-talk mailing list\nTo leave the list write to ship-talk-leave@lists.example", [1]),
        ("Text.\n\n****************************************\nThis message and any files with it are meant only for the person named above.\nIf it reached you by mistake, delete it and tell the sender.\n****************************************", [1]),
        ("AB> old words of theirs\nAB> more of them\n\nMine.", [4]),
        ("Table:\n\n| a | 1 |\n| b | 2 |", [1, 3, 4]),
        ("> quoted line that is rather long and was wrapped by some program so that the\nrest stands alone.\n> and goes on\n\nMine.", [5]),
        ("Am 01.02.2014 um 10:00 schrieb Ann Smith:\n> alt\n\nNeu.\n\nViele Grüße\nBob", [4]),
        ("Buy cheap boats now!", [1]),
        ("", []),
        ("\n \n", []),
    ],
)
def test_marks_of_mails(text, want):
    assert lines_of(text) == want


def test_unmarked_ancestor_is_found_in_the_corpus(spark):
    old = "The surveyor in Port Anna compared the whole list of the ships and sent the corrected table to the harbour office yesterday evening."
    t = lambda d: datetime(2014, 1, d)
    rows = [(1, "plan", old, "ann@a.example", t(1)), (2, "Re: plan", "I agree with that.\n\n" + old, "bob@b.example", t(2)), (3, "plan", old, "eve@e.example", t(3)), (4, "Re: plan", None, None, None), (5, None, "", "x", t(1)), (None, "s", "text", "x", t(1))]
    rows.append(rows[1])
    df = spark.createDataFrame(rows, "email_id long, subject string, text string, from_addr string, received_at timestamp").withColumn("id", F.lit("clash")).withColumn("new", F.lit(0))
    assert {tuple(r) for r in new_text(df).collect()} == {(1, 1), (2, 1), (3, 1)}
    assert new_text(df.limit(0)).count() == 0


def test_recurring_closings(spark):
    rows = [(i, "s", f"Words of mail {i} about ships.\nMore words {i}.\nAnd the end {i}.\nFair winds to you", "ann@a.example", None) for i in range(4)]
    df = spark.createDataFrame(rows, "email_id long, subject string, text string, from_addr string, received_at timestamp")
    assert {r.line_no for r in new_text(df).collect()} == {1, 2, 3}


BODY = " ".join(f"The crew number {i} of the harbour reported a calm sea." for i in range(20))


@pytest.mark.parametrize(
    "text,placeholder,residue",
    [
        ("Dear {{ name }}, your order is ready.", True, False),
        (BODY + " Please call %%NAME%% today.", True, False),
        ("Dear [INSERT NAME],\n" + BODY, True, False),
        ("The course explains how {{ name }} and ${port} mark fields that the mailer fills in.", False, False),
        ("The manual sets the folder with export LOG=${HOME}/log, then starts.", False, False),
        ("«Biliboxi» vendió el astillero.", False, False),
        ("404 Not Found\n\nnginx/1.18", False, True),
        ("Home | News | Sport\nPlease enable JavaScript to continue.", False, True),
        ("Please enable JavaScript to continue.\n" + BODY, False, False),
        ('Traceback (most recent call last):\n  File "/app/a.py", line 3, in x\nKeyError: \'y\'', False, True),
        ("Your text goes here. Your text goes here. Your text goes here.", False, True),
        ("Lorem ipsum dolor sit amet consectetur adipiscing elit.", False, True),
        ("Hackers left the words Page Not Found on the airport board, the inquiry heard.", False, False),
        ("Your search gave 0 hits\nReset the filters.", False, True),
        (BODY, False, False),
    ],
)
def test_trusted_marks(text, placeholder, residue):
    assert rs.has_placeholder(text) is placeholder
    assert (rs.is_filler(text) or rs.is_notice(text)) is residue


def test_residue_spreads_to_near_copies_only(spark):
    odd = "Servum harborum closedum. " + " ".join(f"Notice word{i} of the system stands here." for i in range(12))
    error = "Page not found. " + " ".join("Try again later or go back to the start page." for _ in range(4))
    rows = [(1, error), (2, error.replace("found", "found!")), (3, odd), (4, BODY), (5, BODY + " End."), (6, None), (7, ""), (8, "  "), (9, "Dear {{ name }}, hello."), (10, "Dear Ann, hello."), (10, "Dear Ann, hello."), (None, error), (11, "word " * 50000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("residue", F.lit("clash")).withColumn("words", F.lit(1))
    got = {r.id: (r.placeholder, r.residue) for r in rs.residue(df).collect()}
    assert got == {1: (False, True), 2: (False, True), 9: (True, False), 11: (False, True)}
    assert rs.residue(df.limit(0)).count() == 0


def test_label_passes_over_links(spark, monkeypatch):
    letters = "abcdefghij"
    words = [letters[i // 100] + letters[i // 10 % 10] + letters[i % 10] for i in range(1000)]
    near = list(words)
    near[200] = "changed"

    def _labelled(batches):
        """A reader that trusts document 1 only."""
        import pyarrow as pa
        import xxhash

        from tidemark.llm import p9_residue as rs
    
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            tokens = [rs.masked_words(t) for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([xxhash.xxh128_digest(" ".join(t)) for t in tokens], pa.binary()), pa.array([None] * len(ids), pa.int64()), *(pa.array([rs.simhash(t)[k] for t in tokens], pa.int64()) for k in range(4)), pa.array(list(map(len, tokens)), pa.int32()), pa.array([False] * len(ids)), pa.array([i == 1 for i in ids])], names=["id", "words", "body", "s0", "s1", "s2", "s3", "size", "placeholder", "residue"])

    rows = [(1, " ".join(words)), (2, " ".join(near)), (3, BODY)]
    monkeypatch.setattr(rs, "_reader", _labelled)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.id for r in rs.residue(df).collect()} == {1, 2}


def test_ancestor_is_found_behind_older_mails_of_the_same_wordings(spark):
    words_ = [f"{a}{b}" for a in ("ship", "dock", "crew", "port", "tide") for b in ("one", "two", "three", "four", "five", "six", "seven", "eight")]
    old = " ".join(words_)
    t = lambda d: datetime(2014, 1, d)
    rows = [(i, "other", " ".join(words_[10 * i - 10 : 10 * i + 3]), f"x{i}@x.example", t(i)) for i in range(1, 5)]  # each claims a part
    rows += [(10, "plan", old, "ann@a.example", t(10)), (11, "Re: plan", "I agree.\n\n" + old, "bob@b.example", t(11)), (12, "Re: plan", "Not me.\n\nYes " + old + " indeed", "eve@e.example", t(12))]
    rows.append((13, "Re: plan", "So it is.\n\n" + " ".join(words_[:12] + ["my", "own"] * 15), "kim@k.example", t(13)))
    df = spark.createDataFrame(rows, "email_id long, subject string, text string, from_addr string, received_at timestamp")
    assert {tuple(r) for r in new_text(df).collect() if r.email_id > 10} == {(11, 1), (12, 1), (13, 1), (13, 3)}


def test_residue_spreads_to_all_texts_of_the_similarity(spark):
    """Against brute force, also at distances that SimHash bits do not show."""
    import random

    rng = random.Random(1)
    letters = "abcdefghijklmnopqrstuvwxyz"
    pool = ["".join(rng.choices(letters, k=6)) for _ in range(3000)]
    rows = []
    for k in range(60):
        base = ["lorem", "ipsum", "dolor", "sit", "amet"] + rng.choices(pool, k=rng.choice([30, 60, 120, 300]))
        rows.append((10 * k, "Your text goes here. " * 5 + " ".join(base[:3])))
        for j in range(1, 8):
            made = list(base)
            for _ in range(rng.randrange(max(2, len(base) // 40) + 1)):
                made[rng.randrange(len(made))] = rng.choice(pool)
            rows.append((10 * k + j, " ".join(made)))
    runs = {i: rs.shingles(rs.masked_words(t), rs.SHINGLE) for i, t in rows}
    near = lambda a, b: len(a & b) >= rs.SIMILARITY * len(a | b) - 1e-9
    want = {i for i, t in rows if rs.is_filler(t) or rs.is_notice(t)} | {10 * k + 1 for k in range(60)}
    first = set(want)
    while more := {i for i in runs if i not in want and any(near(runs[i], runs[j]) for j in want)}:
        want |= more
    assert len(want) > len(first) + 60

    df = spark.createDataFrame(rows, "doc_id long, text string")
    with pytest.MonkeyPatch.context() as m:
        m.setattr(rs, "_reader", _trusting_of(rs._reader))
        assert {r.id for r in rs.residue(df).collect()} == want


def _trusting_of(reader):
    def run(batches):
        import pyarrow as pa

        for out in reader(batches):
            trusted = [r or i % 10 == 1 for i, r in zip(out.column("id").to_pylist(), out.column("residue").to_pylist())]
            yield pa.RecordBatch.from_arrays([*out.columns[:-1], pa.array(trusted, pa.bool_())], names=out.schema.names)

    return run


def test_short_paragraphs_go_with_a_found_one(spark):
    old = "The surveyor in Port Anna compared the whole list of the ships and sent the corrected table to the harbour office yesterday evening."
    short = "The boats left at seven sharp."
    t = lambda d: datetime(2014, 1, d)
    rows = [(1, "plan", old + "\n\n" + short, "ann@a.example", t(1)), (2, "Re: plan", f"I agree with that.\n\n{old}\n\n{short}", "bob@b.example", t(2)), (3, "Re: plan", f"I agree with you all here.\n\n{short}", "eve@e.example", t(3))]
    df = spark.createDataFrame(rows, "email_id long, subject string, text string, from_addr string, received_at timestamp")
    assert {tuple(r) for r in new_text(df).collect()} == {(1, 1), (1, 3), (2, 1), (3, 1), (3, 3)}


def _mails(spark, rows):
    return spark.createDataFrame(rows, "email_id long, subject string, text string, from_addr string, received_at timestamp")


def test_quotation_needs_no_reply_mark_and_may_have_two_ancestors(spark):
    one = "The surveyor in Port Anna compared the whole list of the ships and sent the corrected\ntable to the harbour office yesterday evening before the tide turned."
    two = "Nobody at the northern pier has seen the second pilot since the storm, so the insurers\nwill want a statement from each of the lightkeepers by Friday noon."
    t = lambda d: datetime(2014, 1, d)
    rows = [(1, "plan", one, "ann@a.example", t(1)), (2, "pilot", two, "eve@e.example", t(1))]
    rows += [(3, "the plan again", "I agree with that.\n" + one, "bob@b.example", t(2)), (4, "VS: plan", "Fine.\n\n" + one, "kim@k.example", t(2))]
    rows += [(5, "both", "See these two.\n" + one + "\n" + two + "\nWhat now?", "joe@j.example", t(3))]
    # Copies of one text of several senders, and what a sender sends again, are new; so is the earlier mail.
    rows += [(6, "plan", one, "lea@l.example", t(4)), (7, "again", "Once more:\n" + one, "ann@a.example", t(5))]
    got = {}
    for r in new_text(_mails(spark, rows)).collect():
        got.setdefault(r.email_id, []).append(r.line_no)
    assert {k: sorted(v) for k, v in got.items()} == {1: [1, 2], 2: [1, 2], 3: [1], 4: [1], 5: [1, 6], 6: [1, 2], 7: [1, 2, 3]}


def test_short_paragraphs_go_with_their_ancestor(spark):
    long = "The surveyor in Port Anna compared the whole list of the ships and sent the corrected table to the harbour office."
    old = "Please call me then.\n\n" + long
    t = lambda d: datetime(2014, 1, d)
    rows = [(1, "plan", old, "ann@a.example", t(1)), (2, "x", "Good.\n\n" + old, "bob@b.example", t(2)), (3, "y", "Please call me then.\n\nThe pier is closed.", "eve@e.example", t(2))]
    got = {tuple(r) for r in new_text(_mails(spark, rows)).collect()}
    assert got == {(1, 1), (1, 3), (2, 1), (3, 1), (3, 3)}


def test_many_copies_of_a_long_text(spark):
    """One text that most mails hold, under as many senders, is one row for each sender and run in the index."""
    text = " ".join(f"word{i}" for i in range(200))
    rows = [(i, "offer", f"Dear {i}!\n" + text, f"s{i}@x.example", None) for i in range(60)] + [(100, "offer", text, "s@x.example", None)]
    got = {(r.email_id, r.line_no) for r in new_text(_mails(spark, rows)).collect()}
    assert {(i, 1) for i in range(60)} | {(0, 2)} <= got


@pytest.mark.parametrize("mark", ["%(name)s", "{$name}", "<FIRST_NAME>", "[% name %]", "{{ user.name|default:'x' }}", "{{#if user}}", "[Kundenname]", "{FIRSTNAME}", "{Name}", "[Nombre]"])
def test_more_forms_of_placeholders(mark):
    assert rs.has_placeholder(f"Dear {mark}, the harbour office has your papers.")
    assert not rs.has_placeholder(f"The manual explains how {mark} is filled in.")


@pytest.mark.parametrize("text", ["This page isn't working right now.", "Pagina non trovata", "Página não encontrada", "The link you followed may be broken", "Unable to connect to the database."])
def test_more_wordings_of_notices(text):
    assert rs.is_notice(text)


@pytest.mark.parametrize("frames", [1, 3, 10, 20, 60, 90])
def test_dumps_of_any_length(frames):
    java = "java.lang.IllegalStateException: no connection\n" + "\n".join(f"\tat com.example.app.Service{i}.call(Service{i}.java:{i + 10})" for i in range(frames)) + "\nCaused by: java.io.IOException: reset"
    python = "Traceback (most recent call last):\n" + "\n".join(f'  File "/srv/app/module{i}.py", line {i}, in run\n    result = handle(request, context)' for i in range(frames)) + "\nKeyError: 'tide'"
    assert rs.is_notice(java) and rs.is_notice(python)
    assert not rs.is_notice(BODY + "\n" + java)


def test_simhash_tables_find_near_duplicates(spark):
    """Recall of the candidates against brute force, over lengths and kinds of edits."""
    import numpy as np

    rng = random.Random(6)
    vocabulary = [f"v{i}" for i in range(3000)]
    found = met = 0
    for n in [12, 18, 25, 40, 60, 100, 200, 400] * 40:
        a = [rng.choice(vocabulary) for _ in range(n)]
        b = list(a)
        for _ in range(rng.randint(1, max(1, n // 40))):
            k = rng.randrange(len(b))
            b[k : k + rng.randint(0, 1)] = [rng.choice(vocabulary)] * rng.randint(0, 1)
        x, y = (set(zip(*(t[k:] for k in range(5)))) for t in (a, b))
        if x and y and 0.8 <= len(x & y) / len(x | y) < 1:
            met += 1
            d = np.unpackbits((np.array(rs.simhash(a)) ^ np.array(rs.simhash(b))).view(np.uint8))
            found += d.sum() <= rs.HAMMING and not d.reshape(16, 16).any(axis=1).all()
    assert met > 100 and found >= 0.98 * met


def test_labels_spread_over_simhash_links_and_parts(spark, monkeypatch):
    rng = random.Random(8)
    base = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(80)]
    rows = [(0, "Page not found. " + " ".join(base[:3]))]
    text = ["Lorem", "ipsum"] * 40
    chain = [list(base)]
    for i in range(4):
        step = list(chain[-1])
        step[20 * i + 5] = f"new{chr(97 + i)}"
        chain.append(step)
    rows = [(i, " ".join(x)) for i, x in enumerate(chain)] + [(50, " ".join(rng.sample(base, 80))), (51, BODY), (60, " ".join(text))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    made = df.select(F.col("doc_id").alias("id"), "text", F.lit(None).cast("long").alias("origin"), F.lit(None).cast("long").alias("source")).mapInArrow(rs._with_columns(rs._reader), "id long, words binary, body long, s0 long, s1 long, s2 long, s3 long, size int, placeholder boolean, residue boolean, origin long, source long")
    seeds = made.filter("id = 0").select("words")
    for block in (1000, 1):
        monkeypatch.setattr(rs._split_keys, "__defaults__", (block,))
        held = rs.near_labels(made, df.withColumnRenamed("doc_id", "id"), seeds)
        assert {r.id for r in made.join(held, "words").collect()} == {0, 1, 2, 3, 4}


def test_short_bodies_of_many_origins_are_residue(spark):
    say = "Home | News | Sport\nKein Anschluss an das Archiv, Vorgang {}"
    rows = [(i, say.format(i), f"site{i}", "web" if i % 2 else "mail") for i in range(6)] + [(20 + i, "A crew of seven came ashore", "one", "web") for i in range(9)] + [(40, BODY, "x", "web"), (41, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, origin string, source string")
    assert {r.id for r in rs.residue(df, origin="origin", source="source").collect()} == set(range(6))
    assert rs.residue(df).count() == 0


def test_furniture_of_many_sites_needs_no_list(spark):
    """Heads of columns, prompts and inline labels of invented wording, on hosts of few pages."""
    from tidemark.llm import p2_boilerplate as pb

    rows, want, page = [], set(), 0
    for host in range(8):
        for k in range(2):
            page += 1
            tag = f"{chr(97 + host)}{chr(97 + k)}"
            body = [f"Story {tag} of the harbour", f"The crew {tag} came ashore at noon. They had seen the {tag} light for hours before the storm.", "Plim the glorb", "", f"Nobody {tag} had heard the horn of the second pilot. The inquiry {tag} goes on tomorrow."]
            side = ["Zarf und Quux", f"Pilot {tag} moves the old pier", f"Buoy {tag} drifts past the town", "Wibble: a dock burns again " + tag]
            rows.append((page, f"http://h{host}.example/{k}", body[0], "\n".join(body + [""] + side)))
            want |= {(page, 1), (page, 2), (page, 3), (page, 5)}
    df = spark.createDataFrame(rows, "page_id long, url string, title string, text string")
    assert {tuple(r) for r in pb.main_body(df).collect()} == want
    # On one site alone the same lines are few, and its pages are judged on their own.
    assert {tuple(r) for r in pb.main_body(df.limit(1)).collect()} > {(1, 1), (1, 2), (1, 3), (1, 5)}
