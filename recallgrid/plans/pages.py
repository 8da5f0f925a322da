"""Queries over pages and document structure."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import html as hx
from ..functions import text as tx
from ..operators import documents as ds
from .registry import register
from .tables import table

_INSIDE = "coalesce(nullif(regexp_extract(html, '<main\\b[^>]*>(.*?)</main>', 1, 'is'), ''), nullif(regexp_extract(html, '<article\\b[^>]*>(.*?)</article>', 1, 'is'), ''), nullif(regexp_extract(html, '<body\\b[^>]*>(.*?)</body>', 1, 'is'), ''), html)"
_CLEAN = f"regexp_replace(regexp_replace({_INSIDE}, '<script\\b[^>]*>.*?</script>', ' ', 'gis'), '<style\\b[^>]*>.*?</style>', ' ', 'gis')"


def _normal(x):
    return f"trim(regexp_replace(regexp_replace({x}, '\\r\\n?', chr(10), 'g'), '[ \\t]+', ' ', 'g'), ' ' || chr(10) || chr(9) || chr(160))"


def _decoded(x, pairs):
    for entity, plain in pairs:
        x = f"regexp_replace({x}, '{entity}', '{plain.replace(chr(39), chr(39) * 2)}', 'gi')"
    return x


_INNER = lambda x: f"trim(regexp_replace({_decoded(f'regexp_replace({x}, ' + chr(39) + '<[^>]+>' + chr(39) + ', ' + chr(39) + ' ' + chr(39) + ', ' + chr(39) + 'g' + chr(39) + ')', (('&nbsp;', ' '), ('&amp;', '&'), ('&quot;', chr(34)), ('&#39;|&apos;', chr(39)), ('&lt;', '<'), ('&gt;', '>')))}, '\\s+', ' ', 'g'))"


@register(f"""SELECT page_id, {_normal(_decoded(f"regexp_replace(regexp_replace({_CLEAN}, '<(br|p|div|li|tr|h[1-6])\\b[^>]*>', chr(10), 'gi'), '<[^>]+>', ' ', 'g')", hx.ENTITIES))} AS text FROM pages""")
def p1_page_text(spark, sf_dir):
    """P1."""
    return table(spark, sf_dir, "pages").select("page_id", hx.page_text(F.col("html")).alias("text"))


@register(f"""WITH h AS (SELECT page_id, regexp_extract_all({_CLEAN}, '<h[1-6]\\b[^>]*>.*?</h[1-6]>', 0, 'is') AS hs FROM pages),
e AS (SELECT page_id, generate_subscripts(hs, 1) - 1 AS ordinal, unnest(hs) AS h FROM h)
SELECT page_id, ordinal, CAST(substr(h, 3, 1) AS INTEGER) AS level, {_normal("regexp_replace(h, '<[^>]+>', ' ', 'g')")} AS text FROM e""")
def p2_headings(spark, sf_dir):
    """P2."""
    p = table(spark, sf_dir, "pages").select("page_id", F.posexplode(hx.headings(F.col("html"))).alias("ordinal", "h"))
    return p.select("page_id", "ordinal", "h.level", "h.text")


@register(f"""SELECT page_id, coalesce(nullif({_INNER(f"regexp_extract({_INSIDE}, '<h1{chr(92)}b[^>]*>(.*?)</h1>', 1, 'is')")}, ''), nullif({_INNER(f"regexp_extract(html, '<title{chr(92)}b[^>]*>(.*?)</title>', 1, 'is')")}, ''), url) AS title FROM pages""")
def p3_titles(spark, sf_dir):
    """P3."""
    return table(spark, sf_dir, "pages").select("page_id", hx.title(F.col("html"), F.col("url")).alias("title"))


_URL = """u AS (SELECT page_id, url, regexp_replace(url, '#.*$', '') AS whole FROM pages),
q AS (SELECT *, regexp_extract(whole, '^([^?]*)', 1) AS path, list_filter(string_split(regexp_extract(whole, '\\?(.*)$', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(regexp_extract(p, '^([^=]*)', 1), '^(utm_.*|fbclid|gclid)$', 'i')) AS kept FROM u),
c AS (SELECT page_id, CASE WHEN len(kept) = 0 THEN path ELSE path || '?' || array_to_string(kept, '&') END AS canonical FROM q)"""


@register(f"""WITH {_URL}, k AS (SELECT page_id, canonical, regexp_replace(canonical, '/(index\\.html?)?$', '/', 'i') AS key FROM c)
SELECT page_id, canonical, key, row_number() OVER (PARTITION BY key ORDER BY page_id) = 1 AS kept FROM k""")
def p4_canonical_pages(spark, sf_dir):
    """Canonical URLs, and which page of a key stands."""
    u = F.col("url")
    p = table(spark, sf_dir, "pages").select("page_id", hx.canonical_url(u).alias("canonical"), hx.page_key(u).alias("key"))
    return p.withColumn("kept", F.row_number().over(Window.partitionBy("key").orderBy("page_id")) == 1)


_LINKS = f"""a AS (SELECT page_id, url, unnest(regexp_extract_all(SRC, '<a\\b[^>]*href="[^"]*"[^>]*>.*?</a>', 0, 'is')) AS a FROM pages),
h AS (SELECT page_id, url, regexp_extract(a, 'href="([^"]*)"', 1, 'i') AS raw, {_INNER('a')} AS title FROM a),
l AS (SELECT page_id, url, title, CASE WHEN regexp_matches(raw, '^https?://') THEN raw WHEN starts_with(raw, '/') THEN regexp_extract(url, '^(https?://[^/?#]+)', 1) || raw
 ELSE regexp_replace(regexp_replace(url, '[?#].*$', ''), '(^https?://[^/]+/(?:.*/)?)[^/]*$', '\\1') || raw END AS href FROM h WHERE NOT starts_with(raw, '#'))"""


@register(f"""WITH {_LINKS.replace('SRC', 'html')}
SELECT page_id, href, title, regexp_extract(href, '^(https?://[^/?#]+)', 1) = regexp_extract(url, '^(https?://[^/?#]+)', 1)
 AND starts_with(coalesce(nullif(regexp_extract(href, '^https?://[^/?#]+(/[^?#]*)', 1), ''), '/'), CASE WHEN regexp_matches(url, '^https?://[^/?#]+[^?#]*/wiki(/|[?#]|$)', 'i') THEN regexp_extract(url, '^https?://[^/?#]+([^?#]*/wiki)(/|[?#]|$)', 1, 'i') || '/' ELSE coalesce(nullif(regexp_extract(url, '^https?://[^/?#]+(/(?:[^?#]*/)?)', 1), ''), '/') END)
 AND NOT regexp_matches(href, '\\.(css|js|png|jpe?g|gif|svg|zip|pdf)$|/search|/print', 'i') AS in_scope, count(*) AS n FROM l GROUP BY ALL""")
def p6_links(spark, sf_dir):
    """Link edges, and whether a crawl of the page's site may follow them."""
    p = table(spark, sf_dir, "pages").select("page_id", "url", F.inline(hx.links(F.col("html"), F.col("url"))))
    host = lambda c: F.regexp_extract(c, "^https?://([^/?#:]+)", 1)
    origin = lambda c: F.regexp_extract(c, "^(https?://[^/?#]+)", 1)
    scope = (origin("href") == origin("url")) & F.startswith(hx.url_path(F.col("href")), hx.site_scope(F.col("url"))) & ~F.col("href").rlike(r"(?i)\.(css|js|png|jpe?g|gif|svg|zip|pdf)$|/search|/print") & ~hx.private_host(host("href"))
    return p.withColumn("in_scope", scope).groupBy("page_id", "href", "title", "in_scope").agg(F.count("*").alias("n"))


@register(f"""WITH {_LINKS.replace('SRC', "array_to_string(regexp_extract_all(html, '<nav\\b[^>]*>.*?</nav>|<aside\\b[^>]*>.*?</aside>', 0, 'is'), ' ')")}
SELECT page_id, count(*) AS links, count(DISTINCT href) AS targets FROM l GROUP BY page_id HAVING count(*) > 1""")
def p9_navigation(spark, sf_dir):
    """Pages whose navigation sections hold more than one link."""
    sections = F.array_join(F.regexp_extract_all("html", F.lit(f"({hx.NAVIGATION})"), 1), " ")
    p = table(spark, sf_dir, "pages").select("page_id", F.inline(hx.links(sections, F.col("url"))))
    return p.groupBy("page_id").agg(F.count("*").alias("links"), F.count_distinct("href").alias("targets")).where("links > 1")


_MD = "CASE doc_id % 4 WHEN 0 THEN '# T' || chr(10) || text || chr(10) || '## S' || chr(10) || '```' || chr(10) || 'x = 1' || chr(10) || '```' ELSE text END"
_BLOCKS = f"""d AS (SELECT doc_id, {_MD} AS text FROM documents), x AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM d),
n AS (SELECT doc_id, generate_subscripts(ls, 1) - 1 AS no, unnest(ls) AS line FROM x),
f AS (SELECT *, regexp_matches(line, '^\\s*```') AS fence FROM n), g AS (SELECT *, sum(CAST(fence AS INT)) OVER (PARTITION BY doc_id ORDER BY no) % 2 = 1 OR fence AS code FROM f),
h AS (SELECT *, CASE WHEN NOT code THEN nullif(length(regexp_extract(line, '^(#{{1,6}})\\s+\\S', 1)), 0) END AS level, NOT code AND trim(line) = '' AS blank FROM g),
k AS (SELECT *, CASE WHEN coalesce(level IS NOT NULL OR lag(level) OVER w IS NOT NULL OR lag(blank) OVER w OR code <> lag(code) OVER w OR lag(no) OVER w IS NULL, TRUE) THEN 1 ELSE 0 END AS starts FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY no)),
b AS (SELECT *, sum(starts) OVER (PARTITION BY doc_id ORDER BY no) AS block FROM k),
m AS (SELECT doc_id, block, max(level) AS level, bool_or(code) AS code, string_agg(line, chr(10) ORDER BY no) AS raw FROM b WHERE NOT blank AND NOT fence GROUP BY ALL),
blocks AS (SELECT doc_id, CAST(block AS BIGINT) AS block, CASE WHEN level IS NOT NULL THEN 'heading' WHEN code THEN 'code' ELSE 'paragraph' END AS kind, level, trim(CASE WHEN level IS NOT NULL THEN regexp_replace(raw, '^#{{1,6}}\\s+', '') ELSE raw END) AS text FROM m)"""


def _markdown(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.expr(_MD.replace("chr(10)", "char(10)")).alias("text"))


@register(f"WITH {_BLOCKS} SELECT * FROM blocks")
def p10_markdown_blocks(spark, sf_dir):
    """P10; headings and a fence are put into a quarter of the documents first."""
    return ds.markdown_blocks(_markdown(spark, sf_dir))


_PATH = ", ".join(f"CASE WHEN o{i} IS NOT NULL AND (r{i} IS NULL OR o{i}.b > r{i}) THEN o{i}.t END" for i in range(1, 7))
_LAST = ", ".join(f"last_value(CASE WHEN level = {i} THEN {{'b': block, 't': text}} END IGNORE NULLS) OVER w AS o{i}, last_value(CASE WHEN level < {i} THEN block END IGNORE NULLS) OVER w AS r{i}" for i in range(1, 7))


@register(f"""WITH {_BLOCKS}, p AS (SELECT *, {_LAST} FROM blocks WINDOW w AS (PARTITION BY doc_id ORDER BY block ROWS UNBOUNDED PRECEDING))
SELECT doc_id, block, array_to_string(list_filter([{_PATH}], lambda x: x IS NOT NULL), ' > ') AS path FROM p""")
def p11_heading_paths(spark, sf_dir):
    """P11."""
    return ds.heading_paths(ds.markdown_blocks(_markdown(spark, sf_dir))).select("doc_id", "block", F.array_join("path", " > ").alias("path"))


_CODE = "replace(text, '. ', '.' || chr(10) || 'function f' || CAST(doc_id % 5 AS VARCHAR) || '() ')"


@register(f"""WITH d AS (SELECT doc_id, {_CODE} AS text FROM documents), x AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM d),
n AS (SELECT doc_id, generate_subscripts(ls, 1) - 1 AS no, unnest(ls) AS line FROM x),
s AS (SELECT *, nullif(regexp_extract(line, '{ds.SYMBOL}', 1), '') AS symbol FROM n),
b AS (SELECT *, sum(CAST(symbol IS NOT NULL AS INT)) OVER (PARTITION BY doc_id ORDER BY no) AS block FROM s)
SELECT doc_id, max(symbol) AS symbol, min(no) + 1 AS start, max(no) + 1 AS "end", string_agg(line, chr(10) ORDER BY no) AS text FROM b WHERE block > 0 GROUP BY doc_id, block""")
def p12_code_symbols(spark, sf_dir):
    """P12; sentences are turned into declarations first."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.expr(_CODE.replace("chr(10)", "char(10)").replace("VARCHAR", "STRING")).alias("text"))
    return ds.code_symbols(d)


@register()
def p16_chunks(spark, sf_dir):
    """Chunks of prose under headings, and of every fifth document as code, whose sentences are made declarations. Tests hold
    them to the rules."""
    code = F.col("doc_id") % 5 == 4
    declared = F.expr(_CODE.replace("chr(10)", "char(10)").replace("VARCHAR", "STRING"))
    d = table(spark, sf_dir, "documents").select("doc_id", F.when(code, declared).otherwise(F.expr(_MD.replace("chr(10)", "char(10)"))).alias("text"), code.alias("code"))
    return ds.chunks(d)
