"""Queries: scans, delimited text, generations, media types, nested values."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import html as hx
from ..sources import files
from ..sources.nested import json_leaves
from ..sources.shared import fresh_path
from .registry import register
from .tables import table


@register()
def s1_folder_scan(spark, sf_dir):
    """Files under the tables' folder with their size and fingerprint; a test checks what is skipped."""
    return files.scan_folder(spark, sf_dir).select(F.regexp_extract("path", "([^/]+)$", 1).alias("name"), "length", "fingerprint")


@register("""SELECT o_orderkey AS id, o_orderstatus AS status, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderpriority END AS priority FROM orders""")
def s5_delimited_rows(spark, sf_dir):
    """Orders written as lines, some short, some long, some empty, some quoted, and read back."""
    k = F.col("o_orderkey")
    line = F.concat(k.cast("string"), F.lit(',"'), F.col("o_orderstatus"), F.lit('"'), F.when(k % 3 != 0, F.concat(F.lit(","), F.col("o_orderpriority"))).otherwise(""), F.when(k % 15 == 1, ",more,cells").otherwise(""))
    path = fresh_path(spark, "delimited")
    table(spark, sf_dir, "orders").select(F.concat(line, F.when(k % 7 == 0, "\n").otherwise("")).alias("value")).write.text(path)
    c = files.read_delimited(spark, path, 3).select("cells")
    return c.select(c.cells[0].cast("long").alias("id"), c.cells[1].alias("status"), c.cells[2].alias("priority"))


@register("""SELECT doc_id, 2 AS generation, sha256(text || ' v2') AS content_hash FROM documents WHERE doc_id % 2 = 0""")
def s8_generations(spark, sf_dir):
    """An index written generation by generation; a later one leaves the earlier as it is, and reads prune to one."""
    path = fresh_path(spark, "generations")
    d = table(spark, sf_dir, "documents")
    files.write_generation(d.select("doc_id", F.sha2("text", 256).alias("content_hash"), F.lit(1).alias("generation")), path)
    files.write_generation(d.where("doc_id % 2 = 0").select("doc_id", F.sha2(F.concat("text", F.lit(" v2")), 256).alias("content_hash"), F.lit(2).alias("generation")), path)
    return files.read_generation(spark, path, 2).select("doc_id", "generation", "content_hash")


@register("""SELECT page_id, CASE WHEN page_id % 6 = 0 THEN 'application/pdf' WHEN page_id % 4 = 0 THEN 'text/markdown' WHEN page_id % 5 = 0 THEN 'text/x-code'
 WHEN regexp_matches(lower(ltrim(substr(html, 1, 400))), '^(<!doctype html|<html)') THEN 'text/html' ELSE 'text/plain' END AS media_type FROM pages""")
def s3_media_types(spark, sf_dir):
    """S3: leading bytes, then a trusted type, then the extension, then the text's beginning; pages are given each of these."""
    k = F.col("page_id")
    data = F.when(k % 6 == 0, F.concat(F.lit("%PDF-1.7 "), F.col("html"))).otherwise(F.col("html")).cast("binary")
    return table(spark, sf_dir, "pages").select("page_id", hx.media_type(data, F.when(k % 5 == 0, "page.ts").otherwise("page"), F.when(k % 4 == 0, "text/markdown")).alias("media_type"))


_JS = """'{"a":{"b":[{"c":' || k || '},true,null,1.5]},"memory_ids":["m' || event_id || '","m' || user_id || '"],"ref":{"id_of_memory":"m7","other":"x"},"list":[[1,2],[]],"user_memory":{"id":"m9","Memory id":"m8"}}'"""
_PATHS = "replace(replace(substr(fullkey, 3), '\"', ''), '$.', '')"
_LEAVES = f"""WITH j AS (SELECT event_id, {_JS} AS js FROM (SELECT event_id, user_id, json_extract_string(props, '$.k') AS k FROM events)), l AS (SELECT event_id, {_PATHS} AS path, type, coalesce(CASE WHEN type = 'VARCHAR' THEN json_extract_string(atom, '$') ELSE CAST(atom AS VARCHAR) END, 'null') AS value FROM j, json_tree(js) WHERE type NOT IN ('OBJECT', 'ARRAY'))"""


def _leaves(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k"))
    return json_leaves(e.select("event_id", F.expr(_JS).alias("js")), "js", "event_id")


@register(_LEAVES + " SELECT event_id, path, value FROM l")
def s4_json_leaves(spark, sf_dir):
    """Leaves of nested JSON as paths and values; each event's property is put into a deeper value first."""
    return _leaves(spark, sf_dir).select("event_id", "path", "value")


@register(_LEAVES + """, r AS (SELECT DISTINCT event_id, value FROM l WHERE type = 'VARCHAR' AND regexp_matches(regexp_extract(path, '([^.\\[\\]]+)(\\[\\d+\\])*$', 1), 'memory.*id|id.*memory', 'i'))
SELECT event_id, string_agg(value, ',' ORDER BY value) AS ids FROM r GROUP BY event_id""")
def m25_referenced_ids(spark, sf_dir):
    """The ids that nested arguments carry under keys that name a memory's id, each once."""
    key = F.regexp_extract("path", r"([^.\[\]]+)(\[\d+\])*$", 1)
    r = _leaves(spark, sf_dir).where((F.col("kind") == "STRING") & key.rlike("(?i)memory.*id|id.*memory"))
    return r.groupBy("event_id").agg(F.array_join(F.array_sort(F.collect_set("value")), ",").alias("ids"))
