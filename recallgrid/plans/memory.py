"""Queries: memory assertions, relationships, views, task graphs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import memory as mm
from .registry import register
from .tables import EDGES, RECORDS, edges, records, table
from .text import _WORDS


@register(f"""WITH {RECORDS}, r AS (SELECT *, CASE WHEN turn % 4 = 3 THEN 'ok' ELSE content END AS c FROM records)
SELECT ns, sha256(c) AS content_hash, min(id) AS id, count(*) - 1 AS reinforcements, max(authority) AS authority, max(ts) AS last_seen, array_to_string(list_sort(list_distinct(list(role))), ',') AS evidence FROM r GROUP BY ns, sha256(c)""")
def m1_reinforcement(spark, sf_dir):
    """M1; every fourth turn is made to say the same."""
    r = records(spark, sf_dir).withColumn("content", F.when(F.col("turn") % 4 == 3, "ok").otherwise(F.col("content")))
    return mm.reinforced(r).withColumn("evidence", F.array_join("evidence", ","))


@register("""SELECT o_custkey AS key, min(o_orderkey) AS o_orderkey, min(o_orderstatus) <> max(o_orderstatus) AS conflict FROM orders GROUP BY 1""")
def m3_idempotent_commands(spark, sf_dir):
    """M3: orders as commands under their customer's key."""
    o = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "key")
    return mm.idempotent(o, "key", "o_orderkey", "o_orderstatus")


_STATE = f"""WITH {RECORDS}, {EDGES}, l AS (SELECT to_id AS id, arg_max(CASE relation WHEN 'supersede' THEN 'superseded' ELSE 'tombstoned' END, ts * 1000000000 + from_id) AS status FROM edges WHERE relation IN ('supersede', 'retract') GROUP BY 1),
s AS (SELECT r.id, r.ns, r.role, r.authority, r.content, r.turn, coalesce(status, 'active') AS status FROM records r LEFT JOIN l USING (id))"""


@register(_STATE + " SELECT id, ns, status, CASE status WHEN 'active' THEN 'current' WHEN 'superseded' THEN 'historical' ELSE 'invalid' END AS state FROM s")
def m4_lifecycle(spark, sf_dir):
    """M4 and M5: what edges make of their targets."""
    s = mm.lifecycle(records(spark, sf_dir), edges(spark, sf_dir))
    return s.withColumn("state", mm.temporal_state(F.col("status")))


_PROP = f"""WITH {RECORDS}, {EDGES}, p AS (SELECT from_id, to_id, ns, relation, 0.85 + (from_id % 15) / 100.0 AS confidence, from_id % 2 = 0 AS same_referent, to_id % 3 <> 0 AS same_attribute, from_id % 5 <> 0 AS different_value FROM edges),
g AS (SELECT *, CASE relation WHEN 'reinforce' THEN 0.90 WHEN 'supersede' THEN 0.92 WHEN 'conflict' THEN 0.94 WHEN 'retract' THEN 0.95 ELSE 0 END AS bar FROM p),
v AS (SELECT *, array_to_string(list_filter([CASE WHEN confidence < bar THEN 'confidence' END, CASE WHEN relation <> 'coexist' AND NOT same_referent THEN 'referent' END, CASE WHEN relation <> 'coexist' AND NOT same_attribute THEN 'attribute' END, CASE WHEN relation IN ('supersede', 'conflict') AND NOT different_value THEN 'value' END], lambda x: x IS NOT NULL), ',') AS reasons FROM g)"""

#: Confidence that each relation needs; fixed values.
BARS = {"reinforce": 0.90, "supersede": 0.92, "conflict": 0.94, "retract": 0.95}


def proposals(spark, sf_dir):
    f, t = F.col("from_id"), F.col("to_id")
    p = edges(spark, sf_dir).withColumn("confidence", 0.85 + (f % 15) / 100.0).withColumn("same_referent", f % 2 == 0).withColumn("same_attribute", t % 3 != 0).withColumn("different_value", f % 5 != 0)
    r = F.col("relation")
    bar = F.coalesce(*(F.when(r == name, value) for name, value in BARS.items()), F.lit(0.0))
    bound = r != "coexist"
    reasons = F.array_compact(F.array(F.when(F.round("confidence", 6) < bar, F.lit("confidence")), F.when(bound & ~F.col("same_referent"), F.lit("referent")), F.when(bound & ~F.col("same_attribute"), F.lit("attribute")), F.when(r.isin("supersede", "conflict") & ~F.col("different_value"), F.lit("value"))))
    return p.withColumn("reasons", F.array_join(reasons, ","))


@register(_PROP + " SELECT from_id, to_id, relation, reasons, reasons = '' AS valid, CASE WHEN reasons = '' THEN relation ELSE 'coexist' END AS resolved FROM v")
def m6_relationship_gates(spark, sf_dir):
    """M6 and M9: why a proposed relation is turned away, and the relation that stands."""
    p = proposals(spark, sf_dir)
    ok = F.col("reasons") == ""
    return p.select("from_id", "to_id", "relation", "reasons", ok.alias("valid"), F.when(ok, F.col("relation")).otherwise("coexist").alias("resolved"))


@register(_PROP + """, r AS (SELECT ns, from_id, confidence, row_number() OVER w AS k, lead(confidence) OVER w AS nxt FROM v WINDOW w AS (PARTITION BY ns ORDER BY confidence DESC, from_id))
SELECT ns, from_id, round(confidence, 4) AS confidence, coalesce(round(confidence - nxt, 6) < 0.03, FALSE) AS ambiguous FROM r WHERE k = 1""")
def m7_strongest_target(spark, sf_dir):
    """M7: the strongest proposal of a namespace, and whether the next is within 0.03."""
    p = proposals(spark, sf_dir).withColumn("confidence", F.round("confidence", 6))
    return mm.first_and_lead(p, "ns", "confidence", "from_id", 0.03).select("ns", "from_id", F.round("confidence", 4).alias("confidence"), "ambiguous")


@register(_STATE + """ SELECT id, CASE WHEN id % 10 = 0 THEN 'tombstoned' WHEN id % 10 = 1 AND status = 'active' THEN 'conflicted' WHEN id % 10 = 2 AND status = 'active' THEN 'rejected' ELSE status END AS status, 1 + CAST(id % 10 < 2 OR (id % 10 = 2 AND status = 'active') AS INT) AS revision FROM s""")
def m11_marking(spark, sf_dir):
    """Records marked by id, and hypotheses of an abandoned branch rejected; revisions go up by one."""
    s = mm.lifecycle(records(spark, sf_dir), edges(spark, sf_dir))
    k, active = F.col("id") % 10, F.col("status") == "active"
    status = F.when(k == 0, "tombstoned").when((k == 1) & active, "conflicted").when((k == 2) & active, "rejected").otherwise(F.col("status"))
    return s.select("id", status.alias("status"), (1 + ((k < 2) | ((k == 2) & active)).cast("int")).alias("revision"))


@register("""SELECT event_id, coalesce(json_extract_string(props, '$.origin'), 'external') AS origin, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, CASE WHEN CAST(json_extract_string(props, '$.k') AS INTEGER) > 50 THEN 1.0 ELSE 0.25 END AS confidence, TRUE AS legacy FROM events""")
def m13_legacy_adaptation(spark, sf_dir):
    """Old JSON rows mapped to today's fields."""
    p = F.from_json("props", "k int, origin string")
    e = table(spark, sf_dir, "events").withColumn("p", p)
    return e.select("event_id", F.coalesce("p.origin", F.lit("external")).alias("origin"), "p.k", F.when(F.col("p.k") > 50, 1.0).otherwise(0.25).alias("confidence"), F.lit(True).alias("legacy"))


@register(_STATE + """, m AS (SELECT ns, role, id, content, authority, status, row_number() OVER (PARTITION BY ns, role ORDER BY authority DESC, id) AS r FROM s WHERE status <> 'tombstoned')
SELECT ns, role, count(*) AS members, max(authority) AS authority, bool_or(status <> 'active') AS stale, sha256(string_agg(CASE WHEN status = 'active' THEN '' ELSE 'CONFLICT ' END || CAST(id AS VARCHAR), chr(10) ORDER BY r)) AS text_hash FROM m GROUP BY ns, role""")
def m15_scope_views(spark, sf_dir):
    """A view for each scope with its members, text, authority and whether it is stale."""
    s = mm.lifecycle(records(spark, sf_dir), edges(spark, sf_dir)).join(records(spark, sf_dir).select("id", "role", "authority"), "id").where("status <> 'tombstoned'")
    line = F.concat(F.when(F.col("status") == "active", "").otherwise("CONFLICT "), F.col("id").cast("string"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("authority")).alias("a"), "id", line.alias("line")))), lambda x: x["line"]), "\n")
    return s.groupBy("ns", "role").agg(F.count("*").alias("members"), F.max("authority").alias("authority"), F.bool_or(F.col("status") != "active").alias("stale"), F.sha2(text, 256).alias("text_hash"))


@register(f"""WITH {RECORDS} SELECT ns, count(*) AS members, count(*) FILTER (id % 7 = 0) AS missing, count(*) FILTER (id % 7 <> 0 AND turn % 4 = 1) AS changed FROM records GROUP BY ns""")
def m17_view_repair(spark, sf_dir):
    """Members of a view that are gone or changed."""
    r = records(spark, sf_dir)
    now = r.where("id % 7 <> 0").select("id", F.when(F.col("turn") % 4 == 1, F.concat("content", F.lit("!"))).otherwise(F.col("content")).alias("now"))
    j = r.join(now, "id", "left")
    n = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("long"))
    return j.groupBy("ns").agg(F.count("*").alias("members"), n(F.col("now").isNull()).alias("missing"), n(F.col("now") != F.col("content")).alias("changed"))


@register("""SELECT doc_id, CASE WHEN quality = 0 THEN 'secret' ELSE 'plain' END AS category, 'fp_' || substr(sha256(text), 1, 8) AS fingerprint, quality = 0 AS excluded FROM documents JOIN labels USING (doc_id)""")
def m21_secret_projection(spark, sf_dir):
    """What is shown of a secret record; secrets stay out of automatic recall."""
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    secret = F.col("quality") == 0
    return d.select("doc_id", F.when(secret, "secret").otherwise("plain").alias("category"), F.concat(F.lit("fp_"), F.substring(F.sha2("text", 256), 1, 8)).alias("fingerprint"), secret.alias("excluded"))


@register(f"""WITH {RECORDS}, t AS (SELECT id, ns, turn, role, {_WORDS.format('content')} AS ts FROM records), p AS (SELECT *, max(CASE WHEN role = 'user' THEN turn END) OVER (PARTITION BY ns ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ut FROM t)
SELECT p.id, len(list_intersect(p.ts, u.ts)) AS shared, len(list_intersect(p.ts, u.ts)) >= least(2, len(p.ts)) AND len(list_intersect(p.ts, u.ts)) >= 0.35 * len(p.ts) AS grounded FROM p JOIN t u ON u.ns = p.ns AND u.turn = p.ut WHERE p.role = 'assistant'""")
def m24_grounding(spark, sf_dir):
    """Whether an assistant turn's words stand in the user turn before it."""
    t = records(spark, sf_dir).select("id", "ns", "turn", "role", tx.lexical_terms(F.col("content")).alias("ts"))
    w = Window.partitionBy("ns").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    a = t.withColumn("us", F.last(F.when(F.col("role") == "user", F.col("ts")), True).over(w)).where("role = 'assistant' AND us IS NOT NULL")
    n = tx.shared(F.col("ts"), F.col("us"))
    return a.select("id", n.alias("shared"), ((n >= F.least(F.lit(2), F.size("ts"))) & (n >= 0.35 * F.size("ts"))).alias("grounded"))


@register(f"""WITH RECURSIVE {RECORDS}, {EDGES}, b AS (SELECT from_id AS x, to_id AS y FROM edges UNION SELECT to_id, from_id FROM edges), r AS (SELECT x, x AS y FROM b UNION SELECT r.x, b.y FROM r JOIN b ON b.x = r.y)
SELECT x AS node, min(y) AS root FROM r GROUP BY x""")
def r33_linked_closure(spark, sf_dir):
    """Components of linked records, by checkpointed rounds."""
    return mm.connected(edges(spark, sf_dir).select(F.col("from_id").alias("a"), F.col("to_id").alias("b")))


@register("""WITH RECURSIVE e AS (SELECT page_id AS node, (page_id * 2 + 1) % (SELECT count(*) FROM pages) AS next FROM pages WHERE page_id % 3 <> 2),
r AS (SELECT page_id AS seed, page_id AS node, 0 AS place FROM pages WHERE page_id % 5 = 0 UNION ALL SELECT r.seed, e.next, r.place + 1 FROM r JOIN e ON e.node = r.node WHERE r.place < 39)
SELECT seed, node, min(place) AS place FROM r GROUP BY seed, node""")
def p8_next_chains(spark, sf_dir):
    """Pages in order along next links from each seed, 40 at most, ending at a repetition. The pages hold no such links, so
    every third page is given none and the others one by number."""
    p = table(spark, sf_dir, "pages").select(F.col("page_id").alias("node"))
    e = p.where("node % 3 <> 2").withColumn("next", (F.col("node") * 2 + 1) % p.count())
    return mm.follow(e, p.where("node % 5 = 0"), 40)


@register("""WITH RECURSIVE e AS (SELECT DISTINCT l_suppkey AS task, l_partkey % 150 AS needs FROM lineitem), r AS (SELECT task AS s, needs AS t FROM e UNION SELECT r.s, e.needs FROM r JOIN e ON e.task = r.t),
c AS (SELECT DISTINCT s FROM r WHERE s = t), k AS (SELECT DISTINCT e.task, e.needs FROM e WHERE e.needs IN (SELECT s FROM c) OR e.needs IN (SELECT s FROM r WHERE t IN (SELECT s FROM c))) SELECT * FROM k""")
def e18_cycles(spark, sf_dir):
    """Dependencies in or behind a cycle, by peeling."""
    e = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("task"), (F.col("l_partkey") % 150).alias("needs"))
    return mm.cyclic(e)


@register("""WITH t AS (SELECT o_orderkey AS task, o_custkey AS branch, o_orderpriority AS ns, CASE o_orderstatus WHEN 'O' THEN 'pending' WHEN 'P' THEN 'running' ELSE 'succeeded' END AS state FROM orders), a AS (SELECT c_custkey AS branch, ['1-URGENT', '2-HIGH', '5-LOW'][1 + c_custkey % 3] AS ns, TRUE AS gone FROM customer WHERE c_nationkey % 5 = 0),
j AS (SELECT task, t.branch, t.ns, CASE WHEN gone AND state IN ('pending', 'running', 'blocked') THEN 'aborted' ELSE state END AS state FROM t LEFT JOIN a ON a.branch = t.branch AND a.ns = t.ns)
SELECT ns, branch, task, state, count(*) FILTER (state = 'aborted') OVER (PARTITION BY branch, ns) AS aborted FROM j""")
def e19_abort_branch(spark, sf_dir):
    """Open tasks of aborted branches, and how many there are in each. A customer is a branch, a priority a namespace."""
    state = F.when(F.col("o_orderstatus") == "O", "pending").when(F.col("o_orderstatus") == "P", "running").otherwise("succeeded").alias("state")
    tasks = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("task"), F.col("o_custkey").alias("branch"), F.col("o_orderpriority").alias("ns"), state)
    ns = F.element_at(F.array(*map(F.lit, ("1-URGENT", "2-HIGH", "5-LOW"))), (1 + F.col("c_custkey") % 3).cast("int")).alias("ns")
    return mm.abort(tasks, table(spark, sf_dir, "customer").where("c_nationkey % 5 = 0").select(F.col("c_custkey").alias("branch"), ns))
