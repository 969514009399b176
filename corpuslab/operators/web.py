"""Web pages into columns; URLs and links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

#: Elements that hold no text of the page.
DROPPED = ("script", "style", "nav", "footer", "header", "aside", "form", "noscript", "iframe", "svg", "button", "select", "template", "canvas")
SKIPPED_HOSTS = ("facebook.com", "twitter.com", "instagram.com", "youtube.com", "t.me", "wa.me")


def title(html: Column) -> Column:
    """The title element's text, else the og:title property's, else null."""
    own = T.strip(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))
    shared = T.strip(F.regexp_extract(html, r"(?is)<meta[^>]*property=[\"']og:title[\"'][^>]*content=[\"'](.*?)[\"']", 1))
    return F.coalesce(F.nullif(own, F.lit("")), F.nullif(shared, F.lit("")))


def page_text(html: Column) -> Column:
    """The page without dropped elements, comments and tags; entities of the five markup characters resolved; white space collapsed by line."""
    bare = F.regexp_replace(html, rf"(?is)<({'|'.join(DROPPED)})\b[^>]*>.*?</\1\s*>", " ")
    return _text_of(F.regexp_replace(bare, r"(?s)<!--.*?-->", " "))


def _text_of(bare: Column) -> Column:
    lines = F.regexp_replace(bare, r"(?i)<(?:br|/p|/div|/li|/h[1-6]|/tr|/title)\b[^>]*>", "\n")
    plain = F.regexp_replace(lines, "<[^>]*>", " ")
    for entity, character in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        plain = F.replace(plain, F.lit(entity), F.lit(character))
    plain = F.regexp_replace(plain, r"[ \t\r\f]+", " ")
    return T.strip(F.regexp_replace(plain, r" ?\n[ \n]*", "\n"))


def markdown(html: Column) -> Column:
    """Headings, list items, links and bold text in Markdown; the rest as :func:`page_text`."""
    bare = F.regexp_replace(html, rf"(?is)<({'|'.join(DROPPED)})\b[^>]*>.*?</\1\s*>", " ")
    for n in range(1, 7):
        bare = F.regexp_replace(bare, rf"(?i)<h{n}\b[^>]*>", "\n" + "#" * n + " ")
    bare = F.regexp_replace(bare, r"(?i)<li\b[^>]*>", "\n- ")
    bare = F.regexp_replace(bare, r"(?is)<(?:b|strong)\b[^>]*>(.*?)</(?:b|strong)>", "**$1**")
    bare = F.regexp_replace(bare, r"(?is)<a\b[^>]*href=[\"']([^\"']*)[\"'][^>]*>(.*?)</a>", "[$2]($1)")
    return _text_of(bare)


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^https?://([^/?#:]+)", 1))


def file_name(url: Column) -> Column:
    """The path with ``_`` for ``/``; a query adds the start of its MD5; a name of over 150 characters becomes 100 and the MD5's start."""
    path = F.regexp_replace(F.regexp_extract(url, r"^https?://[^/?#]*/?([^?#]*)", 1), "/", "_")
    path = F.when(path == "", "index").otherwise(path)
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    name = F.when(query == "", path).otherwise(F.concat(path, F.lit("_"), F.substring(F.md5(query), 1, 8)))
    return F.when(F.length(name) > 150, F.concat(F.substring(name, 1, 100), F.lit("_"), F.substring(F.md5(name), 1, 8))).otherwise(name)


def crawlable(url: Column, home: Column, depth: int = 5) -> Column:
    """On the same host (with or without www.), not deeper than ``depth``, and no file or account path."""
    plain = lambda h: F.regexp_replace(h, r"^www\.", "")
    path = F.regexp_extract(url, r"^https?://[^/?#]*([^?#]*)", 1)
    return url.rlike("^https?://") & (plain(host(url)) == plain(home)) & (T.count(path, "/[^/]+") <= depth) & ~path.rlike(r"(?i)\.(?:pdf|jpe?g|png|gif|zip|mp[34]|docx?|xlsx?)$") & ~path.rlike("/(?:login|logout|cart|admin)(?:/|$)")


def links(pages: DataFrame, key: str, url: str, html: str) -> DataFrame:
    """key, position and target of each http(s) link of each page."""
    found = F.regexp_extract_all(F.col(html), F.lit(r"(?i)href=[\"'](https?://[^\"']+)[\"']"), F.lit(1))
    return pages.select(key, url, F.posexplode(found).alias("at", "target"))


def first_external(pages: DataFrame, key: str, url: str, html: str, skipped: tuple[str, ...] = SKIPPED_HOSTS) -> DataFrame:
    """The first link of each page to another host that isn't skipped (or below one that is); one row for each such host, the first page's."""
    found = links(pages, key, url, html).withColumn("host", host(F.col("target")))
    skip = F.lit(False)
    for s in skipped:
        skip = skip | (F.col("host") == s) | F.col("host").endswith(f".{s}")
    outer = found.where((F.col("host") != host(F.col(url))) & (F.length("host") >= 4) & ~skip)
    first = outer.groupBy(key).agg(F.min(F.struct("at", "target", "host")).alias("f")).select(key, "f.target", "f.host")
    return first.groupBy("host").agg(F.min(F.struct(key, "target")).alias("p")).select("host", f"p.{key}", "p.target")


def sitemap(xml: Column) -> Column:
    """All addresses that a sitemap names."""
    return F.regexp_extract_all(xml, F.lit(r"(?s)<loc>\s*(.*?)\s*</loc>"), F.lit(1))
