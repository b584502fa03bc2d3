"""Tokenizers, stop words and stems."""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.porter2 import stem
from tidemark.session import ship_package

# The token patterns results are compared under.
INDEX_TOKEN = r"([a-z0-9]+\.)*[a-z0-9]+"
CRAWL_TOKEN = r"([a-z0-9_\-]+\.)*[a-z0-9_\-]+"
ACRONYM = r"^([a-z]\.)+[a-z]$"


def index_terms(text: Column | str, pattern: str = INDEX_TOKEN) -> Column:
    """Array of lower-cased tokens; an acronym such as u.s gets its last point back. Null text: null."""
    text = F.col(text) if isinstance(text, str) else text
    raw = F.regexp_extract_all(F.lower(text), F.lit(pattern), F.lit(0))
    return F.transform(raw, lambda t: F.when(t.rlike(ACRONYM), F.concat(t, F.lit("."))).otherwise(t))


def crawl_terms(text: Column | str) -> Column:
    """Tokens with hyphens and underscores inside."""
    return index_terms(text, CRAWL_TOKEN)


def split_terms(text: Column | str) -> Column:
    """Lower-cased pieces between white space, punctuation kept."""
    text = F.col(text) if isinstance(text, str) else text
    return F.filter(F.split(F.lower(text), r"\s+"), lambda t: t != "")


def folded_terms(text: Column | str) -> Column:
    """As :func:`split_terms` with accents removed (decomposed marks dropped, common Latin letters mapped)."""
    text = F.col(text) if isinstance(text, str) else text
    # Accented letters and their plain forms, in order.
    accented, plain = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy"
    return F.transform(split_terms(text), lambda t: F.regexp_replace(F.translate(t, accented, plain), r"\p{M}", ""))


def query_set(text: Column | str, stop: Iterable[str] = ()) -> Column:
    """Distinct pieces of a query between blanks, each cut at the first of , . ( ) and quotes; U.S. stays whole; case kept."""
    text = F.col(text) if isinstance(text, str) else text
    pieces = F.transform(F.split(text, r"\s+"), lambda t: F.when(t.rlike(r"^([A-Z]\.)+$"), t).otherwise(F.get(F.filter(F.split(t, r'[,.()"]'), lambda p: p != ""), 0)))
    out = F.array_distinct(F.filter(pieces, lambda t: t.isNotNull() & (t != "")))
    stop = list(stop)
    return F.array_except(out, F.array(*map(F.lit, stop))) if stop else out


def word_pairs(text: Column | str) -> Column:
    """Runs of two or more letters, digits and underscores, lower-cased."""
    text = F.col(text) if isinstance(text, str) else text
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0))


def tokens(rows: DataFrame, key: str = "doc_id", text: str = "text", pattern: str = INDEX_TOKEN) -> DataFrame:
    """(key, pos from 1, term) of each token; null and empty texts give no rows."""
    return rows.select(key, F.posexplode(index_terms(text, pattern)).alias("pos", "term")).select(key, (F.col("pos") + 1).alias("pos"), "term")


def default_stop_words() -> list[str]:
    """The stop words that come with Spark for English; another list is a parameter wherever one is used."""
    from pyspark.ml.feature import StopWordsRemover

    return StopWordsRemover.loadDefaultStopWords("english")


def read_stop_words(spark: SparkSession, path: str) -> DataFrame:
    """(word) of a file with one word per line."""
    return spark.read.text(path).select(F.trim("value").alias("word")).filter("word != ''").distinct()


def without_stop_words(tokens_: DataFrame, stop: Iterable[str] | DataFrame, term: str = "term") -> DataFrame:
    """Tokens whose raw form is no stop word; positions keep counting them."""
    if isinstance(stop, DataFrame):
        return tokens_.join(stop.withColumnRenamed(stop.columns[0], term), term, "left_anti")
    return tokens_.filter(~F.col(term).isin(*stop)) if (stop := list(stop)) else tokens_


def _stem_series(terms: pd.Series) -> pd.Series:
    return terms.map(lambda t: None if t is None else stem(t))


def stems(terms: DataFrame, term: str = "term") -> DataFrame:
    """(term, stem) of the distinct terms: Python sees each term once, however often it occurs."""
    ship_package(terms.sparkSession)
    return terms.select(term).filter(F.col(term).isNotNull()).distinct().withColumn("stem", F.pandas_udf(_stem_series, "string")(term))


def stemmed(tokens_: DataFrame, term: str = "term") -> DataFrame:
    """Tokens with ``term`` replaced by its stem."""
    return tokens_.join(stems(tokens_, term), term).withColumn(term, F.col("stem")).drop("stem")
