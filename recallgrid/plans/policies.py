"""Queries: effectiveness, canaries, policy search, context affinity and rerank rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import batches as bt
from ..operators import policy as pl
from ..operators import ranking as rk
from ..sources.shared import fresh_path
from ..streaming import folds
from .analytics import cases
from .lanes import mmr_sql
from .ranking import _H, hits
from .registry import register
from .tables import table

_RATES = """WITH s AS (SELECT user_id % 5 AS policy, count(*) AS n, avg(CAST(event_type IN ('view', 'click', 'purchase') OR event_id % 3 = 0 AS INT)) AS recall, avg(CAST(event_type = 'click' AS INT)) + (user_id % 5) * 0.1 AS use_rate, avg(CAST(event_type = 'error' AS INT)) AS failure_rate, avg(CAST(event_type = 'view' AS INT)) AS correction_rate,
 avg(CAST(event_id % 97 = user_id % 5 AS INT)) AS mismatch_rate, round(avg(CASE WHEN event_id % 2 = 0 THEN value ELSE -value END), 6) AS rerank_gain, avg(CAST(event_id % 7 < user_id % 5 + 1 AS INT)) AS view_rate FROM events GROUP BY 1),
v AS (SELECT user_id % 5 AS policy, value, row_number() OVER (PARTITION BY user_id % 5 ORDER BY value) AS r, count(*) OVER (PARTITION BY user_id % 5) AS n FROM events WHERE value IS NOT NULL), p AS (SELECT policy, min(value) FILTER (r >= 0.95 * n) AS p95 FROM v GROUP BY policy)"""
#: Codes of what a policy's rates point to, with their bounds; fixed values.
CODES = {
    "high-recall-low-use": "recall >= 0.8 AND use_rate < 0.2",
    "high-use-high-failure": "use_rate >= 0.5 AND failure_rate > 0.2",
    "high-correction": "correction_rate > 0.1",
    "project-mismatch": "mismatch_rate > 0.005",
    "rerank-no-benefit": "rerank_gain <= 0",
    "view-high-use": "view_rate >= 0.5",
}


@register(_RATES + f""" SELECT policy, s.n, round(recall, 9) AS recall, round(use_rate, 9) AS use_rate, round(failure_rate, 9) AS failure_rate, round(correction_rate, 9) AS correction_rate, round(mismatch_rate, 9) AS mismatch_rate, round(view_rate, 9) AS view_rate, p95,
array_to_string(list_filter([{', '.join(f"CASE WHEN {c} THEN '{n}' END" for n, c in CODES.items())}], lambda x: x IS NOT NULL), ',') AS codes FROM s JOIN p USING (policy)""")
def a4_effectiveness(spark, sf_dir):
    """A4 and A5: rates and the 95th percentile of each policy, and what they point to."""
    e = table(spark, sf_dir, "events").withColumn("policy", F.col("user_id") % 5)
    share = lambda c: F.avg(c.cast("int"))
    k, i = F.col("event_type"), F.col("event_id")
    s = e.groupBy("policy").agg(
        F.count("*").alias("n"),
        share(k.isin("view", "click", "purchase") | (i % 3 == 0)).alias("recall"),
        (share(k == "click") + F.any_value("policy") * 0.1).alias("use_rate"),
        share(k == "error").alias("failure_rate"),
        share(k == "view").alias("correction_rate"),
        share(i % 97 == F.col("policy")).alias("mismatch_rate"),
        F.round(F.avg(F.when(i % 2 == 0, F.col("value")).otherwise(-F.col("value"))), 6).alias("rerank_gain"),
        share(i % 7 < F.col("policy") + 1).alias("view_rate"),
    )
    p = bt.quantile(e, "policy", "value", "0.95").withColumnRenamed("value", "p95")
    codes = F.array_compact(F.array(*(F.when(F.expr(c), F.lit(n)) for n, c in CODES.items())))
    rates = ("recall", "use_rate", "failure_rate", "correction_rate", "mismatch_rate", "view_rate")
    return s.join(p, "policy").select("policy", "n", *(F.round(c, 9).alias(c) for c in rates), "p95", F.array_join(codes, ",").alias("codes"))


_DAILY = "d AS (SELECT user_id % 5 AS policy, CAST(ts AS DATE) AS day, avg(CAST(event_type = 'error' AS INT)) AS failures, avg(CAST(event_id % 211 = 0 AS INT)) AS mismatch, avg(value) AS latency, avg(CAST(event_type = 'view' AS INT)) AS corrections, row_number() OVER (PARTITION BY user_id % 5 ORDER BY CAST(ts AS DATE)) AS k FROM events GROUP BY 1, 2)"
_METRICS = ("failures", "mismatch", "latency", "corrections")
_EWMA = f"""WITH RECURSIVE {_DAILY}, w AS (SELECT policy, k, {', '.join(_METRICS)} FROM d WHERE k = 1 UNION ALL SELECT d.policy, d.k, {', '.join(f'0.25 * d.{m} + 0.75 * w.{m}' for m in _METRICS)} FROM w JOIN d ON d.policy = w.policy AND d.k = w.k + 1), l AS (SELECT policy, {', '.join(f'arg_max({m}, k) AS {m}' for m in _METRICS)} FROM w GROUP BY policy)
SELECT policy, {', '.join(f'round({m}, 7) AS {m}' for m in _METRICS)}, failures > 0.1 OR mismatch > 0.005 OR latency > 1200 OR corrections > 0.1 AS roll_back FROM l"""


def daily(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events").groupBy((F.col("user_id") % 5).alias("policy"), F.to_date("ts").alias("day"))
    k, i = F.col("event_type"), F.col("event_id")
    return e.agg(F.avg((k == "error").cast("int")).alias("failures"), F.avg((i % 211 == 0).cast("int")).alias("mismatch"), F.avg("value").alias("latency"), F.avg((k == "view").cast("int")).alias("corrections"))


@register(_EWMA)
def a12_canary_watch(spark, sf_dir):
    """Weighted means of four daily metrics, and whether a policy is rolled back."""
    w = pl.ewma(daily(spark, sf_dir), "policy", "day", list(_METRICS))
    return w.select("policy", *(F.round(m, 7).alias(m) for m in _METRICS), pl.regressed().alias("roll_back"))


@register(_EWMA)
def t3_live_canary(spark, sf_dir):
    """The same means kept live over a stream of daily metrics; the state after the last trigger."""
    metrics, out = fresh_path(spark, "metrics"), fresh_path(spark, "canary")
    daily(spark, sf_dir).repartitionByRange(3, "day").sortWithinPartitions("day").write.parquet(metrics)
    stream = spark.readStream.schema(spark.read.parquet(metrics).schema).parquet(metrics)
    keep = lambda batch, number: batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/batch={number}")
    folds.stream_ewma(stream, _METRICS).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{out}-state").trigger(availableNow=True).start().awaitTermination()
    last = spark.read.parquet(out).groupBy("policy").agg(F.max_by(F.struct(*_METRICS), "batch").alias("m")).select("policy", "m.*")
    return last.select("policy", *(F.round(m, 7).alias(m) for m in _METRICS), pl.regressed().alias("roll_back"))


BASE = {"min_authority": 30, "top": 8, "most": 15, "weight": 0.7, "budget": 400}


@register()
def a9_coordinate_search(spark, sf_dir):
    """In each round the eight one-step variants of a policy are replayed over all cases, and the safe one that does
    strictly better is taken, until none does. Tests hold a replay to a plain loop and the choice to its rule."""
    return pl.search(cases(spark, sf_dir), BASE, rounds=4)


_FACET = {"repository": "doc_id % 4 <> 0", "project": "doc_id % 5 <> 0", "task": "doc_id % 3 <> 0", "topic": "doc_id % 2 = 0", "environment": "label % 3 <> 0", "capability": "label % 4 <> 1", "workspace": "doc_id % 7 <> 0", "session": "doc_id % 11 <> 0"}
_MATCH = {"repository": "CAST(doc_id % 2 = query_id % 2 AS INT)", "project": "CAST(label % 3 = 1 AS INT)", "task": "CAST(label % 2 = 0 AS INT)", "topic": "(doc_id % 5) / 4", "environment": "CAST(doc_id % 3 = 0 AS INT)", "capability": "CAST(label % 5 < 3 AS INT)", "workspace": "CAST(doc_id % 2 = 1 AS INT)", "session": "CAST(label % 7 = 0 AS INT)"}


@register(f"""WITH {_H}, a AS (SELECT query_id, doc_id, {', '.join(f'CASE WHEN {_FACET[f]} THEN {_MATCH[f]} END AS {f}' for f in _FACET)} FROM hits),
w AS (SELECT query_id, doc_id, {' + '.join(f'CASE WHEN {f} IS NULL THEN 0 ELSE {w} END' for f, w in rk.FACETS.items())} AS weight, {' + '.join(f'coalesce({f} * {w}, 0)' for f, w in rk.FACETS.items())} AS total FROM a)
SELECT query_id, doc_id, round(CASE WHEN weight = 0 THEN 1 ELSE total / weight END, 9) AS affinity, round(0.5 + 0.5 * CASE WHEN weight = 0 THEN 1 ELSE total / weight END, 9) AS multiplier FROM w""")
def r6_context_affinity(spark, sf_dir):
    """R6 over all eight facets: unknown facets are neutral, the topic counts by its share of candidates."""
    match = {f: F.when(F.expr(_FACET[f]), F.expr(_MATCH[f].replace("AS INT", "AS DOUBLE")).cast("double")) for f in _FACET}
    affinity = rk.affinity(match)
    return hits(spark, sf_dir).select("query_id", "doc_id", F.round(affinity, 9).alias("affinity"), F.round(0.5 + 0.5 * affinity, 9).alias("multiplier"))


_ROUNDS = f"""WITH {_H}, b AS (SELECT query_id, doc_id, score, 60 + doc_id % 200 AS tokens, CAST(floor((row_number() OVER (PARTITION BY query_id ORDER BY doc_id) - 1) / 6) AS BIGINT) AS batch, doc_id % 11 AS relevance, doc_id % 13 AS final_relevance FROM hits),
win AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY query_id, batch ORDER BY relevance DESC, doc_id) <= 3), fin AS (SELECT query_id, count(DISTINCT batch) AS batches, sum(tokens) <= 1800 AS fits FROM win GROUP BY query_id),
n AS (SELECT win.*, fits AND batches > 1 AS again, CASE WHEN max(relevance) OVER w = min(relevance) OVER w THEN 1 ELSE (relevance - min(relevance) OVER w) / (max(relevance) OVER w - min(relevance) OVER w) END AS normal FROM win JOIN fin USING (query_id) WINDOW w AS (PARTITION BY query_id, batch)),
r AS (SELECT b.query_id, b.doc_id, b.score, n.again, CASE WHEN n.again THEN n.final_relevance / 12 ELSE n.normal END AS relevance FROM b LEFT JOIN n USING (query_id, doc_id))"""


@register(_ROUNDS + " SELECT query_id, doc_id, coalesce(again, FALSE) AS final_round, round(0.7 * coalesce(relevance, 0) + 0.3 * score, 7) AS blended FROM r")
def r14_rerank(spark, sf_dir):
    """The best of each batch go into one final batch if they fit its budget, else their relevance is normalised by
    batch; the blend with the score counts a missing relevance as nothing. Relevance is an input, here derived from ids."""
    w = Window.partitionBy("query_id").orderBy("doc_id")
    i = F.col("doc_id")
    b = hits(spark, sf_dir).select("query_id", "doc_id", "score", (60 + i % 200).alias("tokens"), F.floor((F.row_number().over(w) - 1) / 6).alias("batch"), (i % 11).alias("relevance"), (i % 13 / 12).alias("final_relevance"))
    return rk.tournament(b, most=3, budget=1800).select("query_id", "doc_id", "final_round", F.round("blended", 7).alias("blended"))


#: A live policy and one that only watches: least authority, weight of affinity, weight of freshness, share of relevance.
LIVE, SHADOW = (30, 0.8, 0.1, 0.75), (20, 1.0, 0.2, 0.6)
NOW = 100 * 86_400_000


def _policy_sql(name: str, policy: tuple) -> str:
    least, affinity, fresh, share = policy
    trust = "CASE WHEN kind = 'knowledge' THEN authority / 100 ELSE greatest(0.1, authority / 100) * CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 0.6 END END"
    return f""", {name} AS (SELECT query_id, doc_id, round(score * greatest(0, 1 + ({trust} - 1) * {affinity}) * 0.65 + authority / 100 * 0.25 + {fresh} / (1 + greatest(0, ({NOW} - updated) / 86400000) / 30), 9) AS score, list_distinct(['l' || CAST(label AS VARCHAR), 'c' || CAST(content AS VARCHAR)]) AS terms FROM hits WHERE status = 'active' AND authority >= {least})""" + mmr_sql(5, name, f"_{name}", share)


@register(f"WITH RECURSIVE {_H}" + _policy_sql("live", LIVE) + _policy_sql("shadow", SHADOW) + """, b AS (SELECT coalesce(l.query_id, s.query_id) AS query_id, l.mmr_rank AS l, s.mmr_rank AS s, coalesce(l.doc_id, s.doc_id) AS doc_id FROM placed_live l FULL JOIN placed_shadow s ON l.query_id = s.query_id AND l.doc_id = s.doc_id)
SELECT query_id, count(*) FILTER (l IS NOT NULL AND s IS NOT NULL) AS overlap, coalesce(string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY l) FILTER (l IS NOT NULL), '') AS live_top, coalesce(string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY s) FILTER (s IS NOT NULL), '') AS shadow_top FROM b GROUP BY query_id""")
def a16_shadow_ranking(spark, sf_dir):
    """The same candidates gated, scored and picked under another policy, and how many of the two top fives agree."""

    def ranked(policy, name):
        least, affinity, fresh, share = policy
        h = hits(spark, sf_dir).where((F.col("status") == "active") & (F.col("authority") >= least))
        g = rk.gated(F.col("score"), rk.trust(F.col("kind"), F.col("authority"), F.col("doc_id") % 2 == 0), F.lit(affinity))
        h = h.withColumn("score", F.round(rk.authority_and_freshness(g, F.col("authority"), F.col("updated"), NOW, fresh), 9))
        terms = F.array_distinct(F.array(F.concat(F.lit("l"), F.col("label").cast("string")), F.concat(F.lit("c"), F.col("content").cast("string"))))
        h = h.withColumn("terms", terms).withColumn("position", F.row_number().over(rk.best_first("doc_id")))
        return rk.mmr(h, 5, share).select("query_id", "doc_id", F.col("mmr_rank").alias(name))

    b = ranked(LIVE, "l").join(ranked(SHADOW, "s"), ["query_id", "doc_id"], "full_outer")
    top = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col(c).isNotNull(), F.struct(c, F.col("doc_id").cast("string").alias("d"))))), lambda x: x["d"]), ",")
    return b.groupBy("query_id").agg(F.count(F.when(F.col("l").isNotNull() & F.col("s").isNotNull(), 1)).alias("overlap"), top("l").alias("live_top"), top("s").alias("shadow_top"))
