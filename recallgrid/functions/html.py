"""HTML and URL expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import collapsed

#: The five entities that text keeps, and what they stand for; fixed values.
ENTITIES = (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'))
CONTAINERS = ("main", "article", "body")
HEADING = r"(?is)<h[1-6]\b[^>]*>.*?</h[1-6]>"
ANCHOR = r'(?is)<a\b[^>]*href="[^"]*"[^>]*>.*?</a>'
NAVIGATION = r"(?is)<nav\b[^>]*>.*?</nav>|<aside\b[^>]*>.*?</aside>"
TRACKING = r"(?i)^(utm_.*|fbclid|gclid)$"


def container(html: Column) -> Column:
    """The inside of the first main, article or body element, else the whole."""
    inside = (F.nullif(F.regexp_extract(html, rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}>", 1), F.lit("")) for tag in CONTAINERS)
    return F.coalesce(*inside, html)


def without_code(html: Column) -> Column:
    for tag in ("script", "style"):
        html = F.regexp_replace(html, rf"(?is)<{tag}\b[^>]*>.*?</{tag}>", " ")
    return html


def page_text(html: Column) -> Column:
    """Visible text of a page: block elements start lines, tags go, five entities are decoded, spaces collapse."""
    text = F.regexp_replace(without_code(container(html)), r"(?i)<(br|p|div|li|tr|h[1-6])\b[^>]*>", "\n")
    text = F.regexp_replace(text, "<[^>]+>", " ")
    for entity, plain in ENTITIES:
        text = F.regexp_replace(text, f"(?i){entity}", plain)
    return collapsed(text)


def inner_text(html: Column) -> Column:
    """Text of a fragment on one line, with entities decoded."""
    text = F.regexp_replace(html, "<[^>]+>", " ")
    for entity, plain in (("&nbsp;", " "), ("&amp;", "&"), ("&quot;", '"'), ("&#39;|&apos;", "'"), ("&lt;", "<"), ("&gt;", ">")):
        text = F.regexp_replace(text, f"(?i){entity}", plain)
    return F.btrim(F.regexp_replace(text, r"(?U)\s+", " "))


def headings(html: Column) -> Column:
    """array<struct<level, text>> of the headings in the container, in order."""
    found = F.regexp_extract_all(without_code(container(html)), F.lit(f"({HEADING})"), 1)
    return F.transform(found, lambda h: F.struct(F.substring(h, 3, 1).cast("int").alias("level"), collapsed(F.regexp_replace(h, "<[^>]+>", " ")).alias("text")))


def title(html: Column, fallback: Column) -> Column:
    """The first level-one heading of main or article, else the title element, else the fallback."""
    first = F.regexp_extract(container(html), r"(?is)<h1\b[^>]*>(.*?)</h1>", 1)
    element = F.regexp_extract(html, r"(?is)<title\b[^>]*>(.*?)</title>", 1)
    return F.coalesce(F.nullif(inner_text(first), F.lit("")), F.nullif(inner_text(element), F.lit("")), fallback)


def canonical_url(url: Column) -> Column:
    """The URL without its fragment and tracking parameters."""
    whole = F.regexp_replace(url, "#.*$", "")
    path = F.regexp_extract(whole, r"^([^?]*)", 1)
    query = F.regexp_extract(whole, r"\?(.*)$", 1)
    kept = F.array_join(F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.regexp_extract(p, "^([^=]*)", 1).rlike(TRACKING)), "&")
    return F.when(kept == "", path).otherwise(F.concat(path, F.lit("?"), kept))


def page_key(url: Column) -> Column:
    """Canonical URL with a final slash or index page folded, so that both name one page."""
    return F.regexp_replace(canonical_url(url), r"(?i)/(index\.html?)?$", "/")


def links(html: Column, base: Column) -> Column:
    """array<struct<href, title>>: targets made absolute against ``base``; links inside the page are skipped."""
    site = F.regexp_extract(base, r"^(https?://[^/?#]+)", 1)
    folder = F.regexp_replace(F.regexp_replace(base, r"[?#].*$", ""), r"(^https?://[^/]+/(?:.*/)?)[^/]*$", "$1")

    def one(a):
        href = F.regexp_extract(a, r'(?i)href="([^"]*)"', 1)
        absolute = F.when(href.rlike("^https?://"), href).when(href.startswith("/"), F.concat(site, href)).otherwise(F.concat(folder, href))
        return F.struct(href.alias("raw"), absolute.alias("href"), inner_text(a).alias("title"))

    found = F.transform(F.regexp_extract_all(html, F.lit(f"({ANCHOR})"), 1), one)
    kept = F.filter(found, lambda x: ~x["raw"].startswith("#"))
    return F.transform(kept, lambda x: F.struct(x["href"].alias("href"), x["title"].alias("title")))


def private_host(host: Column) -> Column:
    """Hosts that a crawl may not enter: this machine, local names, private address ranges."""
    lower = F.lower(host)
    named = lower.isin("localhost", "::1", "0.0.0.0") | lower.endswith(".local")
    return named | lower.rlike(r"^\[?(fc|fd|fe8|fe9|fea|feb)[0-9a-f]*:") | lower.rlike(r"^(10|127)(\.\d{1,3}){3}$|^169\.254(\.\d{1,3}){2}$|^192\.168(\.\d{1,3}){2}$|^172\.(1[6-9]|2\d|3[01])(\.\d{1,3}){2}$")


def media_type(data: Column, name: Column, trusted: Column | None = None) -> Column:
    """Media type by leading bytes, then as a trusted source says, then by extension, by the beginning, and by NUL bytes."""
    head = F.hex(F.substring(data, 1, 8))
    magic = F.when(head.startswith("25504446"), "application/pdf").when(head.startswith("89504E47"), "image/png").when(head.startswith("FFD8FF"), "image/jpeg").when(head.startswith("47494638"), "image/gif").when(head.startswith("504B0304"), "application/zip")
    extension = F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1))
    known = F.create_map(*(F.lit(x) for pair in (("html", "text/html"), ("htm", "text/html"), ("md", "text/markdown"), ("txt", "text/plain"), ("json", "application/json"), ("csv", "text/csv"), ("ts", "text/x-code"), ("py", "text/x-code")) for x in pair))
    start = F.lower(F.ltrim(F.substring(data, 1, 512).cast("string")))
    sniffed = F.when(start.rlike("^(<!doctype html|<html)"), "text/html").when(start.rlike(r"^[{\[]"), "application/json")
    return F.coalesce(magic, F.lit(None).cast("string") if trusted is None else trusted, known[extension], sniffed, F.when(F.hex(F.substring(data, 1, 8192)).rlike("^(..)*00"), "application/octet-stream"), F.lit("text/plain"))


def url_path(url: Column) -> Column:
    path = F.regexp_extract(url, "^https?://[^/?#]+(/[^?#]*)", 1)
    return F.when(path == "", "/").otherwise(path)


def site_scope(seed: Column) -> Column:
    """What paths of links from a page have to begin with: its wiki's root if it is in one, else its folder."""
    path = url_path(seed)
    wiki = F.regexp_extract(path, "(?i)^(.*/wiki)(?:/|$)", 1)
    return F.when(wiki != "", F.concat(wiki, F.lit("/"))).otherwise(F.regexp_extract(path, "^(.*/)", 1))
