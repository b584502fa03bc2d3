"""Web pages: text, titles, links, canonical addresses and the crawl frontier."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators.order import placed


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def html_text(html: Column | str) -> Column:
    """Visible text: scripts and styles dropped first, then tags; the common entities decoded; white space squeezed."""
    x = F.regexp_replace(_col(html), r"(?is)<(script|style)\b.*?</\1\s*>", " ")
    x = F.regexp_replace(x, r"(?s)<!--.*?-->", " ")
    x = F.regexp_replace(x, r"(?s)<[^>]*>", " ")
    # The entities decoded, the ampersand last.
    for entity, plain in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        x = F.replace(x, F.lit(entity), F.lit(plain))
    return F.regexp_replace(F.regexp_replace(x, r"\s+", " "), "^ | $", "")


def page_title(html: Column | str) -> Column:
    """The title element's text, ``N/A`` where there is none or a blank one."""
    found = F.trim(F.regexp_extract(_col(html), r"(?is)<title[^>]*>(.*?)</title>", 1))
    return F.when(_col(html).isNull() | (found == ""), F.lit("N/A")).otherwise(found)


def hrefs(html: Column | str) -> Column:
    """Targets of the anchors, in order; none for null pages."""
    return F.regexp_extract_all(_col(html), F.lit(r'(?i)<a\s[^>]*?href\s*=\s*["\']([^"\']*)["\']'), F.lit(1))


def page_links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(src, pos from 1, href) of every anchor."""
    return pages.select(F.col(url).alias("src"), F.posexplode(hrefs(html)).alias("p", "href")).select("src", (F.col("p") + 1).alias("pos"), "href")


def canonical_url(url: Column | str, base: Column | str | None = None) -> Column:
    """scheme://host/path of an address.

    Query and fragment go; scheme and host in lower case, http where there is none; default ports,
    ``index.htm(l)``, runs of slashes and dot parts go; percent codes are decoded. With ``base``, rooted and
    schemeless addresses are resolved against it; a bare name is taken as a path beside the
    base's. Null and blank addresses give null.
    """
    x = F.nullif(F.trim(_col(url)), F.lit(""))
    x = F.regexp_replace(x, r"[?#].*$", "")
    if base is not None:
        b = _col(base)
        root = F.regexp_extract(b, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)", 1)
        folder = F.regexp_extract(F.regexp_replace(b, r"[?#].*$", ""), r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/]*(?:/.*)?/)[^/]*$", 1)
        folder = F.when(folder.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*://$") | (folder == ""), F.concat(root, F.lit("/"))).otherwise(folder)
        x = F.when(x.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*://"), x).when(x.startswith("//"), F.concat(F.regexp_extract(b, r"^([A-Za-z][A-Za-z0-9+.\-]*:)", 1), x)).when(x.startswith("/"), F.concat(root, x)).otherwise(F.concat(folder, x))
    x = F.when(x.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*://"), x).when(x.startswith("//"), F.concat(F.lit("http:"), x)).otherwise(F.concat(F.lit("http://"), x))
    scheme = F.lower(F.regexp_extract(x, r"^([^:]*)://", 1))
    host = F.lower(F.regexp_extract(x, r"^[^:]*://([^/]*)", 1))
    host = F.when(scheme == "http", F.regexp_replace(host, r":80$", "")).when(scheme == "https", F.regexp_replace(host, r":443$", "")).otherwise(host)
    path = F.regexp_extract(x, r"^[^:]*://[^/]*(/.*)?$", 1)
    path = F.when(path.rlike("%[0-9A-Fa-f]{2}"), F.coalesce(F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), path)).otherwise(path)
    for _ in range(4):  # a/../ inside one another
        path = F.regexp_replace(path, r"/(?!\.\.?/)[^/]+/\.\.(?=/|$)", "")
    path = F.regexp_replace(path, r"/(?:\.{0,2}/)+", "/")
    path = F.regexp_replace(path, r"(?i)/index\.html?$", "/")
    return F.concat(scheme, F.lit("://"), host, F.when(path == "", F.lit("/")).otherwise(path))


def host(url: Column | str) -> Column:
    """Lower-case host without user, port; null for null."""
    return F.nullif(F.regexp_extract(F.lower(_col(url)), r"^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit(""))


def wanted_links(links: DataFrame, blocked: DataFrame | None = None, href: str = "href") -> DataFrame:
    """Links that are web addresses or paths and whose extension is not in ``blocked`` (ext)."""
    kept = links.filter(~F.lower(F.col(href)).rlike(r"^(javascript|mailto|ftp|tel|data):") & (F.trim(href) != ""))
    if blocked is None:
        return kept
    ext = F.lower(F.regexp_extract(F.regexp_replace(F.col(href), r"[?#].*$", ""), r"(\.[A-Za-z0-9]+)$", 1))
    return kept.withColumn("ext", ext).join(blocked.select("ext"), "ext", "left_anti").drop("ext")


def non_text_extensions(table: DataFrame) -> DataFrame:
    """(ext) of an extension table (ext, mime), without the text types."""
    return table.filter(~F.col("mime").startswith("text/")).select(F.lower("ext").alias("ext")).distinct()


def text_responses(responses: DataFrame, content_type: str = "content_type") -> DataFrame:
    """Responses whose content type begins with text/, case and blanks around ignored; null types are none."""
    return responses.filter(F.lower(F.trim(content_type)).startswith("text/"))


def above(scores: DataFrame, least: float = 0.6, score: str = "score") -> DataFrame:
    """Rows with at least the score ``least``; null and NaN scores are below any."""
    return scores.filter((F.col(score) >= least) & ~F.isnan(score))


def running_means(pages: DataFrame, wave: str, length: str) -> DataFrame:
    """(wave, n, mean): pages and their mean length up to each wave, from sums of the waves. Null lengths count as 0."""
    per = pages.groupBy(wave).agg(F.count(F.lit(1)).alias("c"), F.sum(F.coalesce(length, F.lit(0))).alias("t"))
    upto = Window.orderBy(wave).rowsBetween(Window.unboundedPreceding, Window.currentRow)  # a row for each wave
    return per.select(wave, F.sum("c").over(upto).alias("n"), (F.sum("t").over(upto) / F.sum("c").over(upto)).alias("mean"))


def round_robin(frontier: DataFrame, domain: str = "domain", order: Iterable[str] = ("depth", "url")) -> DataFrame:
    """``frontier`` with ``turn`` (place within the domain) and rows meant to be taken by (turn, domain).

    One domain may hold any share of the frontier; see :func:`tidemark.operators.order.placed`.
    """
    return placed(frontier, [domain], [F.col(c) for c in order], "turn")


def kth_score(scores: DataFrame, k: int, score: str = "score") -> DataFrame:
    """Rows with at least the k-th highest score; all where there are fewer."""
    kept = scores.orderBy(F.desc_nulls_last(score)).limit(k).agg(F.min(score).alias("least"), F.count(F.lit(1)).alias("n"))
    return scores.crossJoin(F.broadcast(kept)).filter((F.col("n") < k) | (F.col(score) >= F.col("least"))).drop("least", "n")  # one row


def merge_pages(left: DataFrame, right: DataFrame, key: str = "url") -> DataFrame:
    """(key, in_links, author): full outer by id, link lists united, authors joined by a blank."""
    l, r = left.select(key, F.col("in_links").alias("l_in"), F.col("author").alias("l_au")), right.select(key, F.col("in_links").alias("r_in"), F.col("author").alias("r_au"))
    empty = F.array().cast(left.schema["in_links"].dataType)
    return l.join(r, key, "full_outer").select(key, F.array_sort(F.array_union(F.coalesce("l_in", empty), F.coalesce("r_in", empty))).alias("in_links"), F.concat_ws(" ", "l_au", "r_au").alias("author"))


def latest(rows: DataFrame, keys: Iterable[str], order: str) -> DataFrame:
    """One row for each key, the last by ``order``: an upsert of all deliveries. Aggregates before the shuffle."""
    keys = list(keys)
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_b"))
    return best.select(*keys, "_b.*")


def with_text(labels: DataFrame, texts: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Labels with the text of their page; labels whose page or text is missing are skipped."""
    return labels.join(texts.filter(F.col(text).isNotNull()), key)
