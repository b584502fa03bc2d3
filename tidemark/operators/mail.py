"""E-mail: MIME parsing, header anomalies, cleaning and n-gram features."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.session import ship_package

MIME_SCHEMA = "path string, subject string, from_addr string, to_addr string, reply_to string, bcc string, message_id string, received array<string>, text string"


def decode(raw: bytes) -> str:
    """UTF-8, else Windows-1252, else Latin-1 (which takes any byte)."""
    for charset in ("utf-8", "cp1252"):
        try:
            return raw.decode(charset)
        except UnicodeDecodeError:
            pass
    return raw.decode("latin-1")


def parse_message(raw: bytes) -> dict:
    """Headers and text of one message: the last plain part, with the text of HTML parts after it."""
    import email
    import re
    from email import policy

    message = email.message_from_string(decode(raw), policy=policy.compat32)
    plain, rich = "", []
    for part in message.walk():
        if part.is_multipart() or part.get_content_maintype() != "text":
            continue
        # Only encoded parts are bytes again; others are text already.
        encoded = str(part.get("Content-Transfer-Encoding", "")).strip().lower() in ("base64", "quoted-printable", "x-uuencode", "uuencode", "uue", "x-uue")
        body = part.get_payload(decode=encoded)
        body = decode(body) if isinstance(body, bytes) else (body or "")
        if part.get_content_subtype() == "html":
            body = re.sub(r"(?is)<(script|style)\b.*?</\1\s*>", " ", body)
            rich.append(re.sub(r"\s+", " ", re.sub(r"(?s)<[^>]*>", " ", body)).strip())
        else:
            plain = body
    head = lambda name: str(message.get(name, "") or "")
    return {
        "subject": head("Subject"), "from_addr": head("From"), "to_addr": head("To"), "reply_to": head("Reply-To") or head("Return-Path"),
        "bcc": head("Bcc"), "message_id": head("Message-ID"), "received": [str(x) for x in message.get_all("Received", [])], "text": " ".join(x for x in (plain, *rich) if x),
    }


def parse_mime(files: DataFrame) -> DataFrame:
    """(path, headers, text) of ``files`` (path string, content binary). Null content gives empty fields."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [{"path": p} | parse_message(bytes(c) if c is not None else b"") for p, c in zip(batch["path"], batch["content"])]
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in MIME_SCHEMA.split(", ")])

    ship_package(files.sparkSession)
    return files.select("path", "content").mapInPandas(run, MIME_SCHEMA)


def address(header: Column | str) -> Column:
    """The last non-blank piece between angle brackets, lower case; the whole where there are none."""
    x = F.col(header) if isinstance(header, str) else header
    return F.lower(F.get(F.reverse(F.filter(F.transform(F.split(x, "[<>]"), lambda p: F.trim(p)), lambda p: p != "")), F.lit(0)))


def domain(addr: Column) -> Column:
    return F.lower(F.substring_index(addr, "@", -1))


# Named time zones of mail headers, in hours from UTC.
ZONES = {"UT": 0, "UTC": 0, "GMT": 0, "Z": 0, "EST": -5, "EDT": -4, "CST": -6, "CDT": -5, "MST": -7, "MDT": -6, "PST": -8, "PDT": -7, "BST": 1, "CET": 1, "CEST": 2, "JST": 9}


def received_time(header: Column | str) -> Column:
    """Time in a Received header such as ``...; Mon, 2 Jan 2006 15:04:05 -0700`` (or EST), as a timestamp; null if none parses."""
    x = F.col(header) if isinstance(header, str) else header
    found = F.regexp_extract(x, r"(\d{1,2} [A-Z][a-z]{2} \d{4} \d{1,2}:\d{2}:\d{2}) \(?(?:[+-]\d{4}|[A-Z]{1,4})\b", 1)
    zone = F.regexp_extract(x, r"\d{1,2}:\d{2}:\d{2} \(?([+-]\d{4}|[A-Z]{1,4})\b", 1)
    offset = F.try_element_at(F.create_map(*(F.lit(v) for name, hours in ZONES.items() for v in (name, f"{hours:+03d}00"))), F.nullif(zone, F.lit("")))
    offset = F.when(zone.rlike(r"^[+-]\d{4}$"), zone).otherwise(offset)
    return F.try_to_timestamp(F.concat(F.nullif(found, F.lit("")), F.lit(" "), offset), F.lit("d MMM yyyy H:mm:ss Z"))


def chosen_headers(mails: DataFrame) -> DataFrame:
    """``mails`` (parsed) with servers_count, and with span_time and wrong_time between the first server (the last header) and the last one.

    Of the Received headers each server puts its own on top. Null times give null spans.
    """
    first, last = F.try_element_at("received", F.lit(-1)), F.try_element_at("received", F.lit(1))
    return mails.select("*", F.greatest(F.size("received"), F.lit(0)).alias("servers_count"), *span(received_time(first), received_time(last)))


def span(early: Column, late: Column) -> tuple[Column, Column]:
    """(seconds between within a day, wrapping; 1 if the later lies before the earlier)."""
    gap = F.unix_timestamp(late) - F.unix_timestamp(early)
    return F.pmod(gap, F.lit(86400)).alias("span_time"), F.coalesce((gap < 0).cast("int"), F.lit(0)).alias("wrong_time")


def header_flags(mails: DataFrame, compat: bool = False) -> DataFrame:
    """``mails`` (from_addr, reply_to, to_addr, bcc, subject, text, message_id) with the anomaly flags as 0/1.

    ``compat`` reproduces the flag for any non-empty subject.
    """
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    greek = r"[\x{0391}-\x{03A9}\x{03B1}-\x{03C9}]"
    odd = F.length(text("subject")) > 0 if compat else text("subject").rlike(greek) | text("subject").rlike(r"[$%!*#@^~]")
    one = lambda c: c.cast("int")
    sender, reply = address(text("from_addr")), address(text("reply_to"))
    return mails.withColumns({
        "weird_char": one(text("from_addr").rlike(greek) | text("reply_to").rlike(greek)),
        "weird_addr": one(F.coalesce((reply != "") & (sender != reply), F.lit(False))),
        "weird_sbj": one(odd),
        "weird_target": one((F.trim(text("to_addr")) == "") & (F.trim(text("bcc")) != "")),
        "weird_content": one(F.trim(text("text")) == ""),
        "weird_msg_id": one(F.coalesce((text("message_id") != "") & (domain(F.regexp_replace(text("message_id"), "[<>]", "")) != domain(sender)), F.lit(False))),
    })


# The characters that cleaning keeps.
KEPT = r"a-zA-Z0-9\\$%'"


def clean_text(text: Column | str) -> Column:
    """Letters, digits and \\ $ % ' kept, everything else one blank."""
    x = F.col(text) if isinstance(text, str) else text
    return F.trim(F.regexp_replace(x, f"[^{KEPT}]+", " "))


def dictionary_words(rows: DataFrame, dictionary: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, text): the blank-separated words that the dictionary (word) holds, case kept in the test, lower-cased, in their order.

    A hash join of the words with the dictionary, whatever its size; keys are unique. Null texts stay null.
    """
    words = rows.select(key, F.posexplode(F.split(text, r"\s+")).alias("pos", "word"))
    known = dictionary.select(F.col(dictionary.columns[0]).alias("word")).filter("word != ''").distinct()
    kept = words.join(known, "word", "left_semi").groupBy(key).agg(F.sort_array(F.collect_list(F.struct("pos", "word"))).alias("l"))
    return rows.select(key, F.col(text).isNull().alias("_none")).join(kept, key, "left").select(key, F.when(~F.col("_none"), F.coalesce(F.lower(F.concat_ws(" ", F.transform("l", lambda x: x["word"]))), F.lit(""))).alias("text"))


def stratified_split(rows: DataFrame, label: str, key: str, share: float = 0.2, buckets: int = 1024) -> DataFrame:
    """``rows`` with ``part`` = test for the first floor(share n) of each label in the order of md5(key), else train.

    A label may hold most rows: places are counted within ranges of the digest, so that no task
    sorts a whole label.
    """
    digest = F.md5(F.col(key).cast("string"))
    keyed = rows.withColumn("_m", digest).withColumn("_b", F.conv(F.substring("_m", 1, 8), 16, 10).cast("long") * buckets / 2**32)
    keyed = keyed.withColumn("_b", F.floor("_b"))
    counts = keyed.groupBy(label, "_b").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(label)
    counts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(w.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("_all", F.sum("_n").over(w)).drop("_n")
    place = F.row_number().over(Window.partitionBy(label, "_b").orderBy("_m", key))
    full = keyed.withColumn("_place", place).join(counts, [label, "_b"])
    test = F.col("_place") + F.col("_before") <= F.floor(F.lit(share) * F.col("_all"))
    return full.withColumn("part", F.when(test, "test").otherwise("train")).select(*rows.columns, "part")


HEADERS = ("weird_char", "weird_addr", "weird_sbj", "weird_target", "weird_content", "weird_msg_id", "servers_count", "span_time", "wrong_time")


def feature_matrix(headers: DataFrame, freqs: DataFrame, key: str) -> DataFrame:
    """(row_id, col_id, value): the nine header features in columns 0 to 8, then the phrases' frequencies in the order of their ids; zeros are left out."""
    entries = F.array(*(F.struct(F.lit(i).cast("long").alias("col_id"), F.col(c).cast("double").alias("value")) for i, c in enumerate(HEADERS)))
    head = headers.select(F.col(key).alias("row_id"), F.explode(entries).alias("x")).select("row_id", "x.col_id", "x.value").filter("value is not null and value != 0")
    return head.unionByName(freqs.select(F.col(key).alias("row_id"), (F.col("phrase_id") + len(HEADERS)).cast("long").alias("col_id"), F.col("freq").cast("double").alias("value")))


def vocabulary(term_docs: DataFrame) -> DataFrame:
    """(term, col_id) by rising term, from 0. Distinct terms only are ordered."""
    spread = term_docs.select("term").distinct().repartitionByRange("term").withColumn("_p", F.spark_partition_id())
    counts = spread.groupBy("_p").agg(F.count(F.lit(1)).alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    place = F.row_number().over(Window.partitionBy("_p").orderBy("term")) - 1
    return spread.withColumn("_r", place).join(F.broadcast(counts), "_p").select("term", (F.col("_r") + F.col("_before")).cast("long").alias("col_id"))  # a row for each partition


def unigram_matrix(postings: DataFrame, vocab: DataFrame, key: str) -> DataFrame:
    """(row key, col_id, value): term frequencies of the vocabulary's terms."""
    return postings.join(vocab, "term").select(F.col(key).alias("row_id"), "col_id", F.col("tf").alias("value"))
