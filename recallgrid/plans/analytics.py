"""Queries: retrieval analytics and policy replay."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import policy as pl
from .ranking import _H, hits
from .registry import register
from .tables import table

_T = f"""WITH {_H}, t AS (SELECT query_id, doc_id, kind, CAST(20 + doc_id % 90 AS BIGINT) AS tokens, unnest(CASE WHEN kind = 'memory' THEN [doc_id, doc_id + 1] ELSE [doc_id] END) AS member, CASE WHEN kind = 'memory' THEN 2 ELSE 1 END AS n FROM hits)"""


def traces(spark, sf_dir) -> DataFrame:
    memory = F.col("kind") == "memory"
    members = F.when(memory, F.array("doc_id", F.col("doc_id") + 1)).otherwise(F.array("doc_id"))
    return hits(spark, sf_dir).select("query_id", "doc_id", "kind", (20 + F.col("doc_id") % 90).alias("tokens"), F.explode(members).alias("member"), F.when(memory, 2).otherwise(1).alias("n"))


@register(_T + " SELECT query_id, doc_id, member, CAST(ceil(tokens / n) AS BIGINT) AS share, sha256(CAST(member AS VARCHAR)) AS term_hash FROM t")
def a1_trace_rows(spark, sf_dir):
    """A1: what a retrieval exposed; views stand for their members, which share the tokens."""
    return traces(spark, sf_dir).select("query_id", "doc_id", "member", F.ceil(F.col("tokens") / F.col("n")).alias("share"), F.sha2(F.col("member").cast("string"), 256).alias("term_hash"))


_O = _T + """, o AS (SELECT event_id % 500 - event_id % 50 % 50 AS query_id, value, event_type, CASE event_type WHEN 'purchase' THEN 'success' WHEN 'error' THEN 'failed' ELSE 'corrected' END AS outcome, event_id % 100 AS used FROM events),
j AS (SELECT t.query_id, member, outcome, member % 100 = used AS was_used FROM t JOIN o USING (query_id))"""


def outcomes(spark, sf_dir) -> DataFrame:
    """(query_id, outcome, used, times): outcomes counted before they meet what was exposed."""
    e = table(spark, sf_dir, "events")
    outcome = F.when(F.col("event_type") == "purchase", "success").when(F.col("event_type") == "error", "failed").otherwise("corrected")
    o = e.groupBy((F.col("event_id") % 500 - F.col("event_id") % 50 % 50).alias("query_id"), outcome.alias("outcome"), (F.col("event_id") % 100).alias("used")).agg(F.count("*").alias("times"))
    return traces(spark, sf_dir).join(o, "query_id").select("query_id", "member", "outcome", (F.col("member") % 100 == F.col("used")).alias("was_used"), "times")


@register(_O + """, util AS (SELECT member, count(*) AS exposures, count(*) FILTER (was_used) AS uses, sum(CASE WHEN outcome = 'success' THEN CASE WHEN was_used THEN 1 ELSE 0.1 END ELSE 0 END) AS a, sum(CASE WHEN outcome <> 'success' THEN CASE WHEN was_used THEN 1 ELSE 0.1 END ELSE 0 END) AS b FROM j GROUP BY member)
SELECT member, exposures, uses, round((1 + a) / (2 + a + b), 9) AS mean, round(greatest(0, least(1, (exposures - 2) / 20)), 9) AS confidence FROM util""")
def a3_utility(spark, sf_dir):
    """A2 and A3: outcomes attributed to what was exposed, and each memory's utility."""
    j = outcomes(spark, sf_dir)
    n = F.col("times")
    credit = F.when(F.col("was_used"), 1.0 * n).otherwise(0.1 * n)
    good = F.col("outcome") == "success"
    u = j.groupBy("member").agg(F.sum(n).alias("exposures"), F.sum(F.when(F.col("was_used"), n).otherwise(0)).alias("uses"), F.sum(F.when(good, credit).otherwise(0.0)).alias("a"), F.sum(F.when(good, 0.0).otherwise(credit)).alias("b"))
    return u.select("member", "exposures", "uses", F.round((1 + F.col("a")) / (2 + F.col("a") + F.col("b")), 9).alias("mean"), F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("exposures") - 2) / 20)), 9).alias("confidence"))


def cases(spark, sf_dir) -> DataFrame:
    h = hits(spark, sf_dir)
    d = F.col("doc_id")
    feature = F.struct(d.alias("id"), "score", (20 + d % 90).cast("int").alias("tokens"), "authority", F.array((d % 7).cast("string"), (d % 11).cast("string")).alias("terms"))
    ids = lambda c: F.array_sort(F.collect_list(F.when(c, d)))
    return h.groupBy(F.col("query_id").alias("case_id")).agg(F.array_sort(F.collect_list(feature)).alias("features"), ids(d % 3 == 0).alias("positive"), ids(d % 4 == 0).alias("evidence"), ids(d % 10 == 9).alias("forbidden"))


@register(f"""WITH {_H} SELECT query_id AS case_id, count(*) AS features, count(*) FILTER (doc_id % 3 = 0) AS positives, array_to_string(list_sort(list(doc_id) FILTER (doc_id % 4 = 0)), ',') AS evidence FROM hits GROUP BY query_id HAVING count(*) FILTER (doc_id % 3 = 0) > 0""")
def a6_replay_cases(spark, sf_dir):
    """Cases with something used, from traces."""
    c = cases(spark, sf_dir).where(F.size("positive") > 0)
    return c.select("case_id", F.size("features").alias("features"), F.size("positive").alias("positives"), F.array_join(F.transform("evidence", lambda x: x.cast("string")), ",").alias("evidence"))


@register("""SELECT event_id, CAST('0x' || substr(sha256('6:canary' || length(CAST(event_id AS VARCHAR)) || ':' || event_id), 1, 8) AS BIGINT) % 100 < 10 AS canary FROM events""")
def a11_canary_split(spark, sf_dir):
    """The share of requests that a canary gets, by a stable hash."""
    k = F.col("event_id").cast("string")
    h = F.sha2(F.concat(F.lit("6:canary"), F.length(k).cast("string"), F.lit(":"), k), 256)
    return table(spark, sf_dir, "events").select("event_id", (F.conv(F.substring(h, 1, 8), 16, 10).cast("long") % 100 < 10).alias("canary"))


@register("""SELECT event_type AS metric, count(*) AS n, round(sum(value), 4) AS total, min(value) AS least, max(value) AS most, round(avg(value), 6) AS mean FROM events WHERE isfinite(value) GROUP BY 1""")
def a14_metric_series(spark, sf_dir):
    """A14."""
    v = F.col("value")
    e = table(spark, sf_dir, "events").where(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return e.groupBy(F.col("event_type").alias("metric")).agg(F.count("*").alias("n"), F.round(F.sum(v), 4).alias("total"), F.min(v).alias("least"), F.max(v).alias("most"), F.round(F.avg(v), 6).alias("mean"))
