"""Queries: gates, scores, selection."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import ranking as rk
from ..operators import similarity as sm
from .lanes import _SIMILAR, _UNITS, dense, mmr_sql
from .registry import register
from .tables import RECORDS, edges, records, table, EDGES
from .text import _TERMS

_H = f"""{_UNITS}, hits AS (SELECT a.vec_id AS query_id, b.vec_id AS doc_id, round(list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2])), 9) AS score, b.label,
10 * (1 + b.label % 10) AS authority, b.vec_id * 86400000 AS updated, b.vec_id % 5 AS content, CASE WHEN b.vec_id % 3 = 0 THEN 'memory' ELSE 'knowledge' END AS kind,
['active', 'superseded', 'conflicted', 'tombstoned'][1 + b.vec_id % 4] AS status FROM u a, u b WHERE a.vec_id % 50 = 0 QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY score DESC, b.vec_id) <= 20)"""


def hits(spark, sf_dir) -> DataFrame:
    """The 20 nearest vectors of each stated query with attributes derived from their ids."""
    labels = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "label")
    h = dense(spark, sf_dir, 20).select("query_id", "doc_id", "score").join(labels, "doc_id")
    i = F.col("doc_id")
    status = F.element_at(F.array(*map(F.lit, ("active", "superseded", "conflicted", "tombstoned"))), (1 + i % 4).cast("int"))
    return h.select("query_id", "doc_id", "score", "label", (10 * (1 + F.col("label") % 10)).alias("authority"), (i * 86400000).alias("updated"), (i % 5).alias("content"), F.when(i % 3 == 0, "memory").otherwise("knowledge").alias("kind"), status.alias("status"))


@register(f"""WITH {_H}, g AS (SELECT query_id, doc_id, kind, CASE WHEN label % 4 = 0 THEN 'local' WHEN label % 4 = 1 THEN 't:u:a:g::p' WHEN label % 4 = 2 THEN 't:u:a:g' ELSE 'x:u:a:g::p' END AS ns, status, doc_id % 2 AS repo, doc_id % 6 AS branch FROM hits)
SELECT query_id, doc_id, coalesce(CASE WHEN kind <> 'memory' THEN CASE WHEN contains(ns, '::') AND NOT starts_with(ns, 't:u:a:g::') THEN 'security:knowledge-scope-mismatch' WHEN NOT contains(ns, '::') THEN 'security:unscoped-legacy-knowledge' END WHEN ns <> 't:u:a:g' THEN 'security:scope-mismatch' END,
CASE WHEN kind = 'memory' AND repo = 1 THEN 'security:project-scope-mismatch' END, CASE WHEN status <> 'active' THEN 'temporal:' || status END, CASE WHEN branch = 4 THEN 'branch:unverified-hypothesis' END) AS reason FROM g""")
def r2_gates(spark, sf_dir):
    """The first gate that turns a hit away: boundary, project scope, status, branch."""
    n, i = F.col("label") % 4, F.col("doc_id")
    ns = F.when(n == 0, "local").when(n == 1, "t:u:a:g::p").when(n == 2, "t:u:a:g").otherwise("x:u:a:g::p")
    boundary = rk.boundary_gate(F.col("kind"), ns, F.lit("t:u:a:g"), F.lit(False))
    project = F.when((F.col("kind") == "memory") & rk.differs(i % 2, F.lit(0)), "security:project-scope-mismatch")
    branch = rk.branch_gate(F.when(i % 6 == 4, "hypothesis").otherwise("asserted"), F.lit(True), F.lit("b"), F.lit("main"))
    return hits(spark, sf_dir).select("query_id", "doc_id", F.coalesce(boundary, project, rk.status_gate(F.col("status"), F.lit(False)), branch).alias("reason"))


@register(f"""WITH {_H}, a AS (SELECT query_id, doc_id, CASE WHEN label % 3 = 0 THEN 'linux' WHEN label % 3 = 1 THEN 'mac' END AS os, CASE WHEN doc_id % 4 = 0 THEN 'npm' WHEN doc_id % 4 = 1 THEN 'pnpm' END AS pm, 18 + doc_id % 6 AS lo FROM hits)
SELECT query_id, doc_id, CASE WHEN pm = 'npm' THEN 'environment:package-manager-mismatch' WHEN lo > 21 THEN 'environment:runtime-version-mismatch' END AS reason,
CASE WHEN pm = 'npm' OR lo > 21 THEN 0 ELSE CASE WHEN os = 'mac' THEN 0.5 ELSE 1.0 END END AS multiplier FROM a""")
def r7_runtime_gate(spark, sf_dir):
    """R7."""
    i, none = F.col("doc_id"), F.lit(None).cast("string")
    os_ = F.when(F.col("label") % 3 == 0, F.array(F.lit("linux"))).when(F.col("label") % 3 == 1, F.array(F.lit("mac")))
    want = {"repository": none, "project": none, "os": os_, "architecture": F.lit(None).cast("array<string>"), "strict_os": F.lit(False), "strict_architecture": F.lit(False), "package_manager": F.when(i % 4 == 0, "npm").when(i % 4 == 1, "pnpm"), "runtime": none, "version_min": F.concat(F.lit("v"), (18 + i % 6).cast("string"), F.lit(".2")), "version_max": none}
    have = {"repository": none, "project": none, "os": F.lit("linux"), "architecture": F.lit("x64"), "package_manager": F.lit("pnpm"), "runtime": F.lit("node"), "runtime_version": F.lit("21.3.1")}
    reason, multiplier = rk.runtime_gate(want, have)
    return hits(spark, sf_dir).select("query_id", "doc_id", reason.alias("reason"), multiplier.alias("multiplier"))


@register(f"""WITH {_H}, p AS (SELECT query_id, doc_id, [{{'kind': 'tool', 'value': 't' || CAST(doc_id % 4 AS VARCHAR), 'required': label % 2 = 0}}, {{'kind': 'other', 'value': 'x', 'required': FALSE}}] AS ps FROM hits)
SELECT query_id, doc_id, len(list_filter(ps, lambda p: p.kind = 'tool' AND p.required AND NOT list_contains(['t0', 't1'], p.value))) = 0 AS allowed, len(list_filter(ps, lambda p: p.kind <> 'tool')) AS unchecked FROM p""")
def r8_prerequisites(spark, sf_dir):
    """A required prerequisite that is known to fail turns a hit away; unknown kinds are counted."""
    p = lambda kind, value, required: F.struct(F.lit(kind).alias("kind"), value.alias("value"), required.alias("required"))
    ps = F.array(p("tool", F.concat(F.lit("t"), (F.col("doc_id") % 4).cast("string")), F.col("label") % 2 == 0), p("other", F.lit("x"), F.lit(False)))
    failed = F.exists(ps, lambda x: (x["kind"] == "tool") & x["required"] & ~F.array_contains(F.array(F.lit("t0"), F.lit("t1")), x["value"]))
    return hits(spark, sf_dir).select("query_id", "doc_id", (~failed).alias("allowed"), F.size(F.filter(ps, lambda x: x["kind"] != "tool")).alias("unchecked"))


@register(f"""WITH {_H}, s AS (SELECT *, CASE WHEN kind = 'knowledge' THEN authority / 100 ELSE greatest(0.1, authority / 100) * CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 0.6 END END AS m FROM hits),
g AS (SELECT *, score * greatest(0, 1 + (m - 1) * 0.8) AS g FROM s), f AS (SELECT *, g * 0.65 + authority / 100 * 0.25 + 0.1 / (1 + greatest(0, (8640000000 - updated) / 86400000) / 30) AS f FROM g)
SELECT query_id, doc_id, round(g, 7) AS gated, round(f, 5) AS final, authority >= 30 AS enough, row_number() OVER (PARTITION BY query_id ORDER BY round(f, 9) DESC, doc_id) AS rank FROM f""")
def r11_scores(spark, sf_dir):
    """Trust, gated score, authority and freshness, and the rank that caps candidates."""
    h = hits(spark, sf_dir)
    h = h.withColumn("g", rk.gated(F.col("score"), rk.trust(F.col("kind"), F.col("authority"), F.col("doc_id") % 2 == 0), F.lit(0.8)))
    h = h.withColumn("score", F.round(rk.authority_and_freshness(F.col("g"), F.col("authority"), F.col("updated"), 100 * 86_400_000), 9))
    return rk.cap(h, 40, "doc_id").select("query_id", "doc_id", F.round("g", 7).alias("gated"), F.round("score", 5).alias("final"), (F.col("authority") >= 30).alias("enough"), "rank")


@register(f"""WITH {_H} SELECT query_id, doc_id, label FROM hits QUALIFY row_number() OVER (PARTITION BY query_id, label, content ORDER BY score DESC, doc_id) = 1""")
def r17_structural_dedupe(spark, sf_dir):
    """R17."""
    return rk.structural_dedupe(hits(spark, sf_dir), "label", "content", tie="doc_id").select("query_id", "doc_id", "label")


_CUT = lambda r, g, s: f"""WITH {_H}, f AS (SELECT query_id, doc_id, CASE WHEN doc_id % 2 = 0 THEN greatest(score, 0.04) ELSE score END AS score FROM hits),
w AS (SELECT *, first_value(score) OVER o AS top, lag(score) OVER o AS before FROM f WINDOW o AS (PARTITION BY query_id ORDER BY score DESC, doc_id)),
s AS (SELECT *, CASE WHEN top < 0.04 OR score < 0.04 OR coalesce(before - score >= greatest({g}, top * {s}), FALSE) OR score / top < {r} THEN 1 ELSE 0 END AS stop FROM w)
SELECT query_id, doc_id, round(score, 7) AS score FROM s QUALIFY max(stop) OVER (PARTITION BY query_id ORDER BY score DESC, doc_id ROWS UNBOUNDED PRECEDING) = 0"""  # noqa: E731


def _cut(spark, sf_dir, focused):
    h = hits(spark, sf_dir).withColumn("score", rk.lexical_floor(F.col("score"), F.col("doc_id") % 2 == 0))
    return rk.adaptive_cutoff(h, "doc_id", focused=focused).select("query_id", "doc_id", F.round("score", 7).alias("score"))


@register(_CUT(0.7, 0.12, 0.24))
def r19_cutoff_focused(spark, sf_dir):
    """R18 and R19 for focused queries."""
    return _cut(spark, sf_dir, True)


@register(_CUT(0.68, 0.14, 0.18))
def r19_cutoff_broad(spark, sf_dir):
    """R18 and R19 for broad queries."""
    return _cut(spark, sf_dir, False)


@register(f"""WITH RECURSIVE {RECORDS}, t AS (SELECT id, ns, turn, {_TERMS.format('content')} AS terms FROM records), p AS (SELECT q.id AS query_id, t.id AS doc_id, round(CASE WHEN len(q.terms) + len(t.terms) = 0 THEN 0 ELSE len(list_intersect(q.terms, t.terms)) / (len(q.terms) + len(t.terms) - len(list_intersect(q.terms, t.terms))) END, 9) AS score, t.terms FROM t q JOIN t ON t.ns = q.ns AND t.turn < q.turn WHERE q.turn % 3 = 0),
cut AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) <= 40)""" + mmr_sql(5) + _SIMILAR + " SELECT query_id, doc_id, score, CAST(mmr_rank AS INT) AS mmr_rank, similarity FROM near JOIN c USING (query_id, doc_id)")
def r20_mmr(spark, sf_dir):
    """R20 over conversations: each user turn's earlier turns, ordered by marginal relevance.

    Turns are counted where they share a term; the others score 0 (null without a text) and come by id, which follows turns,
    so only the first 40 of a conversation with a text, and without one, can still be among a query's 40.
    """
    r = sm.unique(records(spark, sf_dir).where("turn IS NOT NULL"), "ns", "content").select("id", "ns", F.col("turn").alias("at"), tx.terms(F.col("content")).alias("terms"))
    q = r.where("at % 3 = 0").withColumnRenamed("id", "query_id")
    w = Window.partitionBy("ns", F.col("terms").isNull()).orderBy("id")
    first = r.withColumn("place", F.row_number().over(w)).where("place <= 40").select("id", "ns", F.col("at").alias("when"))
    far = q.join(first, "ns").where("when < at").select("query_id", "id", F.lit(0).alias("shared"))
    m = sm.meeting(q, r, ["ns"], "when < at").union(far).groupBy("query_id", "id").agg(F.max("shared").alias("shared"))
    m = m.join(q.select("query_id", F.size("terms").alias("n")), "query_id").join(r.select("id", F.size("terms").alias("m")), "id")
    union = F.col("n") + F.col("m") - F.col("shared")
    score = F.when(union == 0, 0.0).otherwise(F.round(F.col("shared") / union, 9))
    best = rk.cap(m.select(F.col("query_id.id").alias("query_id"), "id", score.alias("score")), 40, "id")
    c = best.join(r.select("id", F.coalesce("terms", F.array().cast("array<string>")).alias("terms")), "id")  # terms only of those kept
    return rk.mmr(c.select("query_id", F.col("id.id").alias("doc_id"), "score", F.col("rank").alias("position"), "terms"), 5)


@register(f"""WITH RECURSIVE {_H}, d AS (SELECT query_id, doc_id, kind, 20 + doc_id % 90 AS cost, row_number() OVER (PARTITION BY query_id ORDER BY score / (20 + doc_id % 90) DESC, score DESC, doc_id) AS i FROM hits),
p AS (SELECT query_id, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS t, CAST(0 AS BIGINT) AS k, CAST(0 AS BIGINT) AS m, CAST(0 AS BIGINT) AS n, FALSE AS fits, CAST(NULL AS BIGINT) AS doc_id, '' AS kind, CAST(0 AS BIGINT) AS cost FROM d WHERE i = 1
UNION ALL SELECT query_id, i, t + CASE WHEN fits THEN cost ELSE 0 END, k + CASE WHEN fits AND kind = 'knowledge' THEN cost ELSE 0 END, m + CASE WHEN fits AND kind = 'memory' THEN cost ELSE 0 END, n + CAST(fits AS INT), fits, doc_id, kind, cost FROM
 (SELECT d.query_id, d.i, t, k, m, n, t + d.cost <= 400 AND NOT (d.kind = 'knowledge' AND k + d.cost > 250) AND NOT (d.kind = 'memory' AND m + d.cost > 200) AS fits, d.doc_id, d.kind, d.cost FROM p JOIN d ON d.query_id = p.query_id AND d.i = p.i + 1))
SELECT query_id, doc_id, kind, cost, CAST(n - 1 AS INT) AS place FROM p WHERE fits""")
def r23_context_packing(spark, sf_dir):
    """Hits that fit the budgets, in order of value for their tokens."""
    h = rk.cap(hits(spark, sf_dir), 100, "doc_id").withColumn("cost", 20 + F.col("doc_id") % 90)
    return rk.pack_context(h.withColumn("density", F.col("score") / F.col("cost")).withColumnRenamed("rank", "position"), total=400, knowledge=250, memory=200).select("query_id", "doc_id", "kind", "cost", "place")


@register(f"""WITH {_H}, s AS (SELECT query_id, doc_id, score, status, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS r FROM hits), t AS (SELECT vec_id - vec_id % 50 AS query_id, vec_id AS target FROM embeddings WHERE vec_id % 7 = 0)
SELECT t.query_id, target, r AS dense_rank, CASE WHEN r IS NULL THEN 'dense' WHEN status <> 'active' THEN 'gate' WHEN r > 5 THEN 'final' END AS first_missing FROM t LEFT JOIN s ON s.query_id = t.query_id AND s.doc_id = t.target""")
def r25_target_loss(spark, sf_dir):
    """For query and target pairs, the first stage at which the target is missing."""
    s = rk.cap(hits(spark, sf_dir), 20, "doc_id").select("query_id", F.col("doc_id").alias("target"), "status", F.col("rank").alias("dense_rank"))
    t = table(spark, sf_dir, "embeddings").where("vec_id % 7 = 0").select((F.col("vec_id") - F.col("vec_id") % 50).alias("query_id"), F.col("vec_id").alias("target"))
    missing = F.when(F.col("dense_rank").isNull(), "dense").when(F.col("status") != "active", "gate").when(F.col("dense_rank") > 5, "final")
    return t.join(s, ["query_id", "target"], "left").select("query_id", "target", "dense_rank", missing.alias("first_missing"))


_BIG = "list_distinct(list_transform(range(0, greatest(length({0}) - 1, 1)), lambda i: substr({0}, i + 1, 2)))"
_FLAT = "regexp_replace(lower(content), '[\\p{P}\\p{S}\\s]+', '', 'g')"


@register(f"""WITH {RECORDS}, p AS (SELECT id, ns, turn, role, {_FLAT} AS flat FROM records), b AS (SELECT *, CASE WHEN flat = '' THEN [] ELSE {_BIG.format('flat')} END AS g FROM p),
l AS (SELECT *, lag(g) OVER (PARTITION BY ns ORDER BY turn) AS before FROM b)
SELECT id, round(CASE WHEN len(g) = 0 OR len(before) = 0 THEN 0 ELSE len(list_intersect(g, before)) / greatest(len(g), len(before)) END, 9) AS strength,
CASE WHEN before IS NULL THEN 'none' ELSE CASE WHEN len(list_intersect(g, before)) / greatest(len(g), len(before), 1) >= 0.72 THEN 'direct' WHEN len(list_intersect(g, before)) / greatest(len(g), len(before), 1) >= 0.4 THEN 'related' WHEN len(list_intersect(g, before)) > 0 THEN 'weak' ELSE 'none' END END AS support FROM l WHERE before IS NOT NULL""")
def r31_support(spark, sf_dir):
    """How far a turn's character pairs support the next turn."""
    w = Window.partitionBy("ns").orderBy("turn")
    r = records(spark, sf_dir).select("id", "ns", "turn", tx.bigrams(F.col("content")).alias("g"))
    r = r.withColumn("before", F.lag("g").over(w)).where("before IS NOT NULL").withColumn("s", tx.overlap(F.col("g"), F.col("before")))
    level = F.when(F.col("s") >= 0.72, "direct").when(F.col("s") >= 0.4, "related").when(F.col("s") > 0, "weak").otherwise("none")
    return r.select("id", F.round("s", 9).alias("strength"), level.alias("support"))


@register(f"""WITH {RECORDS}, p AS (SELECT id, ns, role, CASE WHEN length(content) <= 300 THEN content ELSE substr(content, 1, 300) || '...' END AS text, CASE WHEN turn % 4 = 0 THEN 'historical' ELSE 'current' END AS state, row_number() OVER (PARTITION BY ns ORDER BY authority DESC, id) AS rank FROM records)
SELECT ns, id, text, state, rank FROM p WHERE rank <= 5""")
def r34_public_projection(spark, sf_dir):
    """The five records of a namespace that may be shown, trimmed to 300 characters."""
    c = F.col("content")
    r = records(spark, sf_dir).withColumn("rank", F.row_number().over(Window.partitionBy("ns").orderBy(F.desc("authority"), "id"))).where("rank <= 5")
    return r.select("ns", "id", F.when(F.char_length(c) <= 300, c).otherwise(F.concat(F.substring(c, 1, 300), F.lit("..."))).alias("text"), F.when(F.col("turn") % 4 == 0, "historical").otherwise("current").alias("state"), "rank")


@register("""WITH a AS (SELECT DISTINCT l_partkey AS id FROM lineitem), m AS (SELECT id, (SELECT count(*) FROM part WHERE p_partkey = id) AS p, (SELECT count(*) FROM supplier WHERE s_suppkey = id) AS s, (SELECT count(*) FROM customer WHERE c_custkey = id) AS c FROM a)
SELECT id, CASE WHEN p + s + c = 0 THEN 'not_found' WHEN p + s + c > 1 THEN 'ambiguous' WHEN p = 1 THEN 'part' WHEN s = 1 THEN 'supplier' ELSE 'customer' END AS resolved FROM m""")
def r35_reference_resolution(spark, sf_dir):
    """Ids without a prefix are looked for in three stores; none is not found, several are ambiguous."""
    ids = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("id")).distinct()
    for name, key in (("part", "p_partkey"), ("supplier", "s_suppkey"), ("customer", "c_custkey")):
        ids = ids.join(table(spark, sf_dir, name).select(F.col(key).alias("id"), F.lit(name).alias(name)), "id", "left")
    found = F.array_compact(F.array("part", "supplier", "customer"))
    return ids.select("id", F.when(F.size(found) == 0, "not_found").when(F.size(found) > 1, "ambiguous").otherwise(found[0]).alias("resolved"))


@register(f"""WITH {RECORDS}, {EDGES}, x AS (SELECT from_id AS id, to_id AS other, CASE relation WHEN 'supersede' THEN 2 WHEN 'conflict' THEN 3 END AS p FROM edges WHERE relation IN ('supersede', 'conflict')
UNION ALL SELECT to_id, from_id, 1 FROM edges WHERE relation = 'supersede'), r AS (SELECT *, row_number() OVER (PARTITION BY id, p ORDER BY other) AS k FROM x QUALIFY k <= 3)
SELECT id, other, p AS priority, row_number() OVER (PARTITION BY id ORDER BY p, other) AS place FROM r QUALIFY place <= 5""")
def r36_evolution_chain(spark, sf_dir):
    """A record's successor, what it superseded and what it conflicts with: three of a kind, five in all."""
    e = edges(spark, sf_dir)
    own = e.where("relation IN ('supersede', 'conflict')").select(F.col("from_id").alias("id"), F.col("to_id").alias("other"), F.when(F.col("relation") == "supersede", 2).otherwise(3).alias("priority"))
    x = own.union(e.where("relation = 'supersede'").select("to_id", "from_id", F.lit(1)))
    x = x.withColumn("k", F.row_number().over(Window.partitionBy("id", "priority").orderBy("other"))).where("k <= 3")
    return x.withColumn("place", F.row_number().over(Window.partitionBy("id").orderBy("priority", "other"))).where("place <= 5").drop("k")
