"""Queries: access, lookups, integrity, consolidation, task dependencies and expiry."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import artifacts as af
from ..operators import memory as mm
from .memory import _PROP, _STATE, proposals
from .registry import register
from .tables import edges, records, table

_MODES = ("personal", "team", "multi_tenant")
_INTENTS = ("explicit_id", "automatic_recall", "semantic_search")


@register("""WITH r AS (SELECT o_orderkey AS id, o_custkey % 7 AS owner, o_custkey % 5 AS tenant, o_orderkey % 7 AS as_user, o_orderkey % 5 AS as_tenant, ['personal', 'team', 'multi_tenant'][1 + (o_orderkey // 35) % 3] AS mode, ['explicit_id', 'automatic_recall', 'semantic_search'][1 + (o_orderkey // 7) % 3] AS intent,
 ['global', 'repository', 'project', 'task'][1 + o_custkey % 4] AS kind, o_custkey % 3 AS scope, CASE WHEN o_orderkey % 4 <> 1 THEN o_orderkey % 3 END AS repository, CASE WHEN o_orderkey % 8 <> 2 THEN o_orderkey % 3 END AS project, o_orderkey % 3 AS task FROM orders),
x AS (SELECT *, CASE kind WHEN 'global' THEN FALSE WHEN 'repository' THEN coalesce(scope <> repository, TRUE) WHEN 'project' THEN coalesce(scope <> project, TRUE) ELSE scope <> task END AS crossed FROM r)
SELECT id, CASE WHEN owner <> as_user THEN 'different_owner' WHEN tenant <> as_tenant THEN 'different_tenant' WHEN NOT crossed THEN 'allow' WHEN mode = 'multi_tenant' THEN 'not_found' WHEN mode = 'personal' THEN CASE WHEN intent = 'automatic_recall' THEN 'not_found' ELSE 'allow' END
 WHEN intent = 'explicit_id' AND id % 2 = 0 THEN 'allow' ELSE 'team_denied' END AS decision, owner = as_user AND tenant = as_tenant AND crossed AS cross_scope FROM x""")
def m19_access(spark, sf_dir):
    """Whether a request may see a resource: owner, tenant, then what its mode and intent allow across scopes. A team's
    own policy, here even ids, may let an explicit id pass."""
    c, o = F.col("o_custkey"), F.col("o_orderkey")
    one = lambda names, i: F.element_at(F.array(*map(F.lit, names)), (1 + i).cast("int"))
    r = table(spark, sf_dir, "orders").select(o.alias("id"), (c % 7 == o % 7).alias("owns"), (c % 5 == o % 5).alias("same_tenant"), one(_MODES, F.floor(o / 35) % 3).alias("mode"), one(_INTENTS, F.floor(o / 7) % 3).alias("intent"), one(("global", "repository", "project", "task"), c % 4).alias("kind"), (c % 3).alias("scope"), F.when(o % 4 != 1, o % 3).alias("repository"), F.when(o % 8 != 2, o % 3).alias("project"), (o % 3).alias("task"))
    crossed = F.lit(False)
    for kind in ("repository", "project", "task"):
        crossed = F.when(F.col("kind") == kind, F.coalesce(F.col("scope") != F.col(kind), F.lit(True))).otherwise(crossed)
    r = r.withColumn("crossed", crossed)
    policy = (F.col("intent") == "explicit_id") & (F.col("id") % 2 == 0)
    decision = F.when(~F.col("owns"), "different_owner").when(~F.col("same_tenant"), "different_tenant").when(~F.col("crossed"), "allow").when(F.col("mode") == "multi_tenant", "not_found")
    decision = decision.when(F.col("mode") == "personal", F.when(F.col("intent") == "automatic_recall", "not_found").otherwise("allow")).when(policy, "allow").otherwise("team_denied")
    return r.select("id", decision.alias("decision"), (F.col("owns") & F.col("same_tenant") & F.col("crossed")).alias("cross_scope"))


@register("""WITH r AS (SELECT o_orderkey AS id, CASE WHEN o_custkey % 9 <> 0 THEN o_custkey % 4 END AS owner, CASE WHEN o_custkey % 8 <> 0 THEN o_custkey % 3 END AS tenant, o_custkey % 2 AS boundary, o_orderstatus AS status FROM orders),
q AS (SELECT DISTINCT l_orderkey * 10 + l_linenumber AS request, l_orderkey + l_linenumber % 2 * 100000000 AS id, l_partkey % 4 AS as_user, l_suppkey % 3 AS as_tenant, CASE WHEN l_linenumber % 3 <> 0 THEN l_partkey % 2 END AS boundary, l_linenumber % 2 = 0 AS strict FROM lineitem)
SELECT request, q.id, status FROM q JOIN r ON r.id = q.id WHERE coalesce(owner, 0) = as_user AND (NOT strict OR coalesce(tenant, 0) = as_tenant) AND (q.boundary IS NULL OR q.boundary = r.boundary)""")
def m27_bounded_lookup(spark, sf_dir):
    """Records by id, only where owner, in the strict mode the tenant, and a named boundary are the request's."""
    c, n = F.col("o_custkey"), F.col("l_linenumber")
    r = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.coalesce(F.when(c % 9 != 0, c % 4), F.lit(0)).alias("owner"), F.coalesce(F.when(c % 8 != 0, c % 3), F.lit(0)).alias("tenant"), (c % 2).alias("within"), F.col("o_orderstatus").alias("status"))
    q = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + n).alias("request"), (F.col("l_orderkey") + n % 2 * 100000000).alias("id"), (F.col("l_partkey") % 4).alias("as_user"), (F.col("l_suppkey") % 3).alias("as_tenant"), F.when(n % 3 != 0, F.col("l_partkey") % 2).alias("boundary"), (n % 2 == 0).alias("strict")).distinct()
    j = q.join(r, "id").where((F.col("owner") == F.col("as_user")) & (~F.col("strict") | (F.col("tenant") == F.col("as_tenant"))) & F.coalesce(F.col("boundary") == F.col("within"), F.lit(True)))
    return j.select("request", "id", "status")


@register("""WITH r AS (SELECT o_orderkey AS id, o_custkey % 2 AS boundary, unnest(CASE WHEN o_orderkey % 10 = 0 THEN [NULL] ELSE [{'kind': 'user', 'ref': o_custkey}, {'kind': 'artifact', 'ref': o_custkey + o_orderkey % 3 * 1000}] END) AS x FROM orders),
t AS (SELECT 'user' AS kind, c_custkey AS ref, c_custkey % 2 AS boundary FROM customer UNION ALL SELECT 'artifact', p_partkey, p_partkey % 2 FROM part),
j AS (SELECT id, x IS NULL AS none, t.ref IS NOT NULL AS found FROM r LEFT JOIN t ON t.kind = x.kind AND t.ref = x.ref AND t.boundary = r.boundary)
SELECT id, count(*) FILTER (found) AS found, CASE WHEN bool_or(none) THEN 'missing' WHEN bool_and(found) THEN 'valid' ELSE 'invalid' END AS integrity FROM j GROUP BY id""")
def m10_evidence_integrity(spark, sf_dir):
    """Whether every referenced id exists in the table of its kind, inside the record's boundary; none at all is missing."""
    c, o = F.col("o_custkey"), F.col("o_orderkey")
    refs = F.array(F.struct(F.lit("user").alias("kind"), c.alias("ref")), F.struct(F.lit("artifact").alias("kind"), (c + o % 3 * 1000).alias("ref")))
    r = table(spark, sf_dir, "orders").select(o.alias("id"), (c % 2).alias("boundary"), F.explode_outer(F.when(o % 10 != 0, refs)).alias("x")).select("id", "boundary", F.col("x.kind").alias("kind"), F.col("x.ref").alias("ref"))
    known = table(spark, sf_dir, "customer").select(F.lit("user").alias("kind"), F.col("c_custkey").alias("ref")).union(table(spark, sf_dir, "part").select(F.lit("artifact"), "p_partkey"))
    j = r.join(known.withColumn("boundary", F.col("ref") % 2).withColumn("hit", F.lit(True)), ["kind", "ref", "boundary"], "left").withColumn("hit", F.col("hit").isNotNull())
    return j.groupBy("id").agg(F.sum(F.col("hit").cast("long")).alias("found"), F.when(F.bool_or(F.col("kind").isNull()), "missing").when(F.bool_and("hit"), "valid").otherwise("invalid").alias("integrity"))


@register(_PROP + """, l AS (SELECT to_id AS id, arg_max(CASE relation WHEN 'supersede' THEN 'superseded' ELSE 'tombstoned' END, ts * 1000000000 + from_id) AS status FROM edges WHERE relation IN ('supersede', 'retract') GROUP BY 1),
s AS (SELECT v.*, a.authority AS mine, b.authority AS theirs, a.ts AS mine_ts, b.ts AS theirs_ts, coalesce(x.status, 'active') AS own, coalesce(y.status, 'active') AS other, row_number() OVER (PARTITION BY to_id, v.relation ORDER BY from_id) AS nth FROM v JOIN records a ON a.id = from_id JOIN records b ON b.id = to_id LEFT JOIN l x ON x.id = from_id LEFT JOIN l y ON y.id = to_id)
SELECT from_id, to_id, CASE WHEN own <> 'active' THEN 'skip:incoming_not_active' WHEN other <> 'active' THEN 'skip:target_not_active' WHEN reasons <> '' OR relation = 'coexist' THEN 'skip:coexist' WHEN mine < theirs THEN 'skip:lower_authority' WHEN mine_ts < theirs_ts AND relation = 'supersede' THEN 'skip:older' WHEN nth > 1 THEN 'skip:duplicate_operation'
 WHEN relation = 'reinforce' THEN 'merge' ELSE relation END AS action, CASE WHEN own = 'active' AND other = 'active' AND reasons = '' AND relation = 'reinforce' AND mine >= theirs AND nth = 1 THEN 'superseded' END AS incoming_becomes FROM s""")
def m8_consolidation(spark, sf_dir):
    """M8: what consolidating each proposal does, or why it is skipped; a reinforcing record merges into its target and is
    superseded."""
    r = records(spark, sf_dir).select("id", "authority", "ts")
    life = mm.lifecycle(records(spark, sf_dir), edges(spark, sf_dir)).select("id", "status")
    p = proposals(spark, sf_dir).drop("ts").join(r.toDF("from_id", "mine", "mine_ts"), "from_id").join(r.toDF("to_id", "theirs", "theirs_ts"), "to_id").join(life.toDF("from_id", "own"), "from_id").join(life.toDF("to_id", "other"), "to_id")
    p = p.withColumn("nth", F.row_number().over(Window.partitionBy("to_id", "relation").orderBy("from_id")))
    c = F.col
    action = F.when(c("own") != "active", "skip:incoming_not_active").when(c("other") != "active", "skip:target_not_active").when((c("reasons") != "") | (c("relation") == "coexist"), "skip:coexist").when(c("mine") < c("theirs"), "skip:lower_authority")
    action = action.when((c("mine_ts") < c("theirs_ts")) & (c("relation") == "supersede"), "skip:older").when(c("nth") > 1, "skip:duplicate_operation").when(c("relation") == "reinforce", "merge").otherwise(c("relation"))
    return p.withColumn("action", action).select("from_id", "to_id", "action", F.when(c("action") == "merge", "superseded").alias("incoming_becomes"))


_VIEWED = """k AS (SELECT *, CASE WHEN turn % 5 = 0 THEN 'project' WHEN turn % 7 = 0 THEN 'topic' WHEN role = 'user' THEN 'user' WHEN role = 'assistant' THEN 'task' END AS kind, CASE WHEN turn % 5 = 0 THEN ns % 4 WHEN turn % 7 = 0 THEN turn WHEN role = 'user' THEN ns % 9 ELSE ns END AS scope_id FROM s WHERE id % 19 <> 0 AND status <> 'rejected' AND id % 17 <> 0 AND id % 23 <> 0),
m AS (SELECT k.*, turn * 86400000 AS ts, row_number() OVER (PARTITION BY kind, scope_id, ns ORDER BY authority DESC, id) AS r FROM k WHERE kind IS NOT NULL)"""


@register(_STATE + f""", {_VIEWED} SELECT kind, scope_id, ns, count(*) AS members, count(*) AS revision, max(authority) AS authority, min(ts) AS created, max(ts) + 2592000000 AS expires, CASE WHEN max(ts) + 2592000000 <= 2800000000 THEN 'stale' ELSE 'active' END AS state,
sha256(string_agg(CAST(id AS VARCHAR) || '=' || sha256(content), chr(10) ORDER BY r)) AS facts_hash, sha256(string_agg(CASE WHEN status = 'active' THEN '' ELSE 'CONFLICT ' END || content, chr(10) ORDER BY r)) AS text_hash FROM m GROUP BY kind, scope_id, ns""")
def m15_scope_views(spark, sf_dir):
    """A view for each scope: its facts by record, members, revisions, expiry, whether it is stale at the clock,
    its text with conflicts marked, and the highest authority. Pending, rejected, hypothetical and secret records stay out."""
    r = records(spark, sf_dir)
    s = mm.lifecycle(r, edges(spark, sf_dir)).join(r.drop("ns", "ts"), "id").withColumn("ts", F.col("turn") * 86400000)
    i, t, u = F.col("id"), F.col("turn"), F.col("role") == "user"
    s = s.where((i % 19 != 0) & (F.col("status") != "rejected") & (i % 17 != 0) & (i % 23 != 0))
    kind = F.when(t % 5 == 0, "project").when(t % 7 == 0, "topic").when(u, "user").when(F.col("role") == "assistant", "task")
    scope = F.when(t % 5 == 0, F.col("ns") % 4).when(t % 7 == 0, t).when(u, F.col("ns") % 9).otherwise(F.col("ns"))
    s = s.withColumn("kind", kind).withColumn("scope_id", scope).where("kind IS NOT NULL")
    mark = F.when(F.col("status") == "active", "").otherwise("CONFLICT ")
    line = F.struct((-F.col("authority")).alias("a"), "id", F.concat(i.cast("string"), F.lit("="), F.sha2("content", 256)).alias("fact"), F.concat(mark, F.col("content")).alias("text"))
    v = s.groupBy("kind", "scope_id", "ns").agg(F.count("*").alias("members"), F.count("*").alias("revision"), F.max("authority").alias("authority"), F.min("ts").alias("created"), (F.max("ts") + 2592000000).alias("expires"), F.array_sort(F.collect_list(line)).alias("lines"))
    joined = lambda name: F.sha2(F.array_join(F.transform("lines", lambda x: x[name]), "\n"), 256)
    return v.select("kind", "scope_id", "ns", "members", "revision", "authority", "created", "expires", F.when(F.col("expires") <= 2800000000, "stale").otherwise("active").alias("state"), joined("fact").alias("facts_hash"), joined("text").alias("text_hash"))


@register("""WITH d AS (SELECT o_orderkey AS task, unnest([o_orderkey - 1, o_orderkey - 7, o_custkey]) AS needs FROM orders WHERE o_orderstatus = 'O'), j AS (SELECT task, needs, o_orderstatus = 'F' AS done FROM d LEFT JOIN orders ON o_orderkey = needs)
SELECT task, count(*) AS needs, count(*) FILTER (done) AS done, bool_and(coalesce(done, FALSE)) AS ready FROM j GROUP BY task""")
def e17_ready_tasks(spark, sf_dir):
    """Open tasks all of whose dependencies are tasks that have succeeded."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    d = o.where("o_orderstatus = 'O'").select(k.alias("task"), F.explode(F.array(k - 1, k - 7, F.col("o_custkey"))).alias("needs"))
    j = d.join(o.select(k.alias("needs"), (F.col("o_orderstatus") == "F").alias("done")), "needs", "left").withColumn("done", F.coalesce("done", F.lit(False)))
    return j.groupBy("task").agg(F.count("*").alias("needs"), F.sum(F.col("done").cast("long")).alias("done"), F.bool_and("done").alias("ready"))


@register("""WITH c AS (SELECT sha256(text) AS artifact_id, CASE WHEN doc_id % 4 <> 3 THEN 1700000000000 + doc_id * 3600000 + CASE WHEN doc_id % 4 = 0 THEN 86400000 ELSE 1814400000 END END AS expires FROM documents),
a AS (SELECT artifact_id, count(*) AS captures, CASE WHEN count(*) = count(expires) THEN max(expires) END AS expires FROM c GROUP BY artifact_id) SELECT artifact_id, captures, expires, CASE WHEN expires <= 1702520000000 THEN 'expired' ELSE 'ready' END AS state FROM a""")
def e13_expired_artifacts(spark, sf_dir, now: int = 1_702_520_000_000):
    """Artifacts whose last capture's time to live is over at the clock; those with a capture without one stay."""
    k = F.col("doc_id")
    ttl = F.when(k % 4 == 0, 86400000).when(k % 4 != 3, 1814400000)
    captures = table(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("artifact_id"), (1700000000000 + k * 3600000 + ttl).alias("expires"))
    return af.expired(captures, now)
