"""Queries: candidate formation and learning."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import similarity as sm
from .registry import register
from .tables import EPISODES, RECORDS, episode_events, records, table
from .text import _WORDS


@register(f"""WITH {RECORDS} SELECT ns, role, ['task', 'repository', 'project', 'user'][least(min(CASE role WHEN 'user' THEN 4 WHEN 'assistant' THEN 2 ELSE 3 END), max(1 + turn % 4))] AS scope FROM records GROUP BY ns, role""")
def l3_scope_ceiling(spark, sf_dir):
    """L3: a proposed scope no wider than its evidence allows."""
    ceiling = F.when(F.col("role") == "user", 4).when(F.col("role") == "assistant", 2).otherwise(3)
    rank = F.least(F.min(ceiling), F.max(1 + F.col("turn") % 4)).cast("int")
    return records(spark, sf_dir).groupBy("ns", "role").agg(F.element_at(F.array(*map(F.lit, ("task", "repository", "project", "user"))), rank).alias("scope"))


@register(f"""WITH {RECORDS}, t AS (SELECT id, ns, {_WORDS.format("content || CASE WHEN turn % 3 = 0 THEN '' ELSE ' again' END")} AS ts FROM records WHERE role = 'user'),
p AS (SELECT a.id, b.id AS other, len(list_intersect(a.ts, b.ts)) / greatest(len(a.ts), len(b.ts)) AS o FROM t a JOIN t b ON a.ns = b.ns AND b.id < a.id WHERE len(list_intersect(a.ts, b.ts)) > 0)
SELECT id, arg_max(other, o * 1000000 - other / 1000000.0) AS same_as, round(max(o), 6) AS overlap, max(o) >= 0.65 AS merges FROM p GROUP BY id""")
def l4_near_duplicate_merge(spark, sf_dir):
    """L4: the earlier statement of a scope that shares most words; two thirds make them one. Statements meet at shared words."""
    content = F.concat("content", F.when(F.col("turn") % 3 == 0, "").otherwise(" again"))
    t = sm.unique(records(spark, sf_dir).where("role = 'user'"), "ns", "content").select("id", "ns", tx.lexical_terms(content).alias("terms"))
    p = sm.sharing(t, t, ["ns"], "other < id").withColumn("o", F.col("shared") / F.greatest("n", "m"))
    return p.groupBy("id").agg(F.max_by("other", F.struct("o", -F.col("other"))).alias("same_as"), F.round(F.max("o"), 6).alias("overlap"), (F.max("o") >= 0.65).alias("merges"))


_CAND = """c AS (SELECT user_id, event_type, count(*) AS n, count(DISTINCT CAST(ts AS DATE)) AS days, max(value) AS confidence, min(event_id) AS first_seen, max(event_id) AS last_seen, least(1, 0.4 + 0.15 * count(*)) AS utility FROM events GROUP BY ALL)"""


@register(f"""WITH {_CAND} SELECT user_id, event_type, n, days, confidence, first_seen, last_seen, round(utility, 6) AS utility, CASE WHEN event_type = 'signup' AND n >= 1 THEN 'explicit' WHEN days >= 3 THEN 'repeated' WHEN days >= 2 AND confidence > 100 THEN 'strong' ELSE 'waiting' END AS eligibility,
CASE WHEN event_type = 'error' THEN 'expired' WHEN event_type = 'signup' OR days >= 3 OR (days >= 2 AND confidence > 100) THEN 'promoted' ELSE 'candidate' END AS state FROM c""")
def l5_candidates(spark, sf_dir):
    """Candidates gathered from observations, whether they are eligible, and what becomes of them."""
    c = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.count_distinct(F.to_date("ts")).alias("days"), F.max("value").alias("confidence"), F.min("event_id").alias("first_seen"), F.max("event_id").alias("last_seen"), F.round(F.least(F.lit(1.0), 0.4 + 0.15 * F.count("*")), 6).alias("utility"))
    explicit, repeated, strong = F.col("event_type") == "signup", F.col("days") >= 3, (F.col("days") >= 2) & (F.col("confidence") > 100)
    c = c.withColumn("eligibility", F.when(explicit, "explicit").when(repeated, "repeated").when(strong, "strong").otherwise("waiting"))
    return c.withColumn("state", F.when(F.col("event_type") == "error", "expired").when(explicit | repeated | strong, "promoted").otherwise("candidate"))


_MINED = f"""WITH {EPISODES}, s AS (SELECT *, coalesce(max(CASE WHEN kind = 'goal' THEN seq END) OVER (PARTITION BY user_id, day), 0) AS steer FROM episode_events), a AS (SELECT * FROM s WHERE seq > steer),
f AS (SELECT user_id, day, min(CASE WHEN failed THEN seq END) AS failure FROM a GROUP BY ALL), r AS (SELECT user_id, day, failure, min(CASE WHEN kind = 'tool_result' AND NOT failed AND seq > failure THEN seq END) AS recovery, max(CASE WHEN kind = 'verification' THEN seq END) AS verified FROM a JOIN f USING (user_id, day) GROUP BY ALL)"""


@register(_MINED + " SELECT user_id, day, failure, recovery, verified, verified > recovery AS useful FROM r WHERE failure IS NOT NULL AND recovery IS NOT NULL AND verified IS NOT NULL")
def l9_recovery_mining(spark, sf_dir):
    """After the last steering of an episode, the first failure, the first success after it and the last check."""
    w = Window.partitionBy("user_id", "day")
    e = episode_events(spark, sf_dir)
    a = e.withColumn("steer", F.coalesce(F.max(F.when(F.col("kind") == "goal", F.col("seq"))).over(w), F.lit(0))).where("seq > steer")
    a = a.withColumn("failure", F.min(F.when(F.col("failed"), F.col("seq"))).over(w)).where("failure IS NOT NULL")
    r = a.groupBy("user_id", "day", "failure").agg(F.min(F.when((F.col("kind") == "tool_result") & ~F.col("failed") & (F.col("seq") > F.col("failure")), F.col("seq"))).alias("recovery"), F.max(F.when(F.col("kind") == "verification", F.col("seq"))).alias("verified"))
    return r.where("recovery IS NOT NULL AND verified IS NOT NULL").withColumn("useful", F.col("verified") > F.col("recovery"))


_OUT = """o AS (SELECT user_id, CAST(ts AS DATE) AS day, arg_min(event_type <> 'error', event_id) AS ok, min(event_id) AS first FROM events GROUP BY ALL),
b AS (SELECT user_id, count(*) AS outcomes, sum(CAST(ok AS INT)) AS s, count(*) - sum(CAST(ok AS INT)) AS f FROM o GROUP BY user_id)"""


#: Why a candidate isn't qualified, in the order asked.
_QUALIFIES = """, CASE WHEN user_id % 13 = 0 THEN 'invalid_state' WHEN outcomes < 3 THEN 'insufficient_outcomes' WHEN (1 + s) / (2 + s + f) < 0.7 THEN 'success_rate' WHEN user_id % 7 = 0 THEN 'missing_validation_plan' WHEN user_id % 11 = 0 THEN 'missing_success_evidence' ELSE 'qualified' END"""


@register(f"""WITH {_OUT} SELECT user_id, outcomes, s AS successes, f AS failures, round((1 + s) / (2 + s + f), 9) AS estimate{_QUALIFIES} AS verdict FROM b""")
def l10_outcomes(spark, sf_dir):
    """One outcome for each session and task, the estimate of success, and whether it qualifies."""
    o = table(spark, sf_dir, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.min_by(F.col("event_type") != "error", "event_id").alias("ok"))
    b = o.groupBy("user_id").agg(F.count("*").alias("outcomes"), F.sum(F.col("ok").cast("long")).alias("successes")).withColumn("failures", F.col("outcomes") - F.col("successes"))
    p = (1 + F.col("successes")) / (2 + F.col("outcomes"))
    return b.withColumn("estimate", F.round(p, 9)).withColumn("verdict", _verdict(p))


def _verdict(p):
    """State, count, estimate, plan and evidence, in this order; the last two and rejected states are given by user."""
    u = F.col("user_id")
    return F.when(u % 13 == 0, "invalid_state").when(F.col("outcomes") < 3, "insufficient_outcomes").when(p < 0.7, "success_rate").when(u % 7 == 0, "missing_validation_plan").when(u % 11 == 0, "missing_success_evidence").otherwise("qualified")


@register(f"""WITH o AS (SELECT user_id, CAST(ts AS DATE) AS day, CAST(arg_min(event_type <> 'error', event_id) AS INT) AS ok FROM events GROUP BY ALL),
c AS (SELECT user_id, day, sum(ok) OVER w AS s, count(*) OVER w AS n FROM o WINDOW w AS (PARTITION BY user_id ORDER BY day)), e AS (SELECT user_id, day, (1 + s) / (2 + n) AS p FROM c)
SELECT user_id, arg_max(round(p, 6), day) AS estimate, round(min(p), 6) AS lowest, CASE WHEN arg_max(p, day) < 0.40 THEN 'retired' WHEN arg_max(p, day) < 0.55 THEN 'degraded' WHEN min(p) < 0.55 THEN 'requalified' ELSE 'evaluating' END AS state FROM e GROUP BY user_id""")
def l11_experience_state(spark, sf_dir):
    """The state that a candidate's ordered outcomes lead to."""
    o = table(spark, sf_dir, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.min_by((F.col("event_type") != "error").cast("int"), "event_id").alias("ok"))
    w = Window.partitionBy("user_id").orderBy("day")
    e = o.select("user_id", "day", ((1 + F.sum("ok").over(w)) / (2 + F.count("*").over(w))).alias("p"))
    last = F.max_by("p", "day")
    return e.groupBy("user_id").agg(F.round(last, 6).alias("estimate"), F.round(F.min("p"), 6).alias("lowest"), F.when(last < 0.40, "retired").when(last < 0.55, "degraded").when(F.min("p") < 0.55, "requalified").otherwise("evaluating").alias("state"))


@register("""SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey) AS rank FROM part WHERE p_type = 'ECONOMY' QUALIFY rank <= 64""")
def l15_reusable(spark, sf_dir):
    """The newest 64 promoted procedures of a scope."""
    w = Window.partitionBy("p_brand").orderBy(F.desc("p_size"), "p_partkey")
    return table(spark, sf_dir, "part").where("p_type = 'ECONOMY'").select("p_brand", "p_partkey", F.row_number().over(w).alias("rank")).where("rank <= 64")


@register(f"""WITH {RECORDS}, t AS (SELECT id, {_WORDS.format('content')} AS ts FROM records WHERE role = 'user'), c AS (SELECT item_id AS topic, {_WORDS.format('text')} AS cs FROM benchmark),
m AS (SELECT id, topic, len(list_intersect(ts, cs)) / least(len(ts), len(cs)) AS sim FROM t, c WHERE len(list_intersect(ts, cs)) > 0), b AS (SELECT id, arg_max(topic, round(sim, 9) * 1000000 - topic / 1000000.0) AS topic, max(sim) AS sim FROM m GROUP BY id),
a AS (SELECT t.id, CASE WHEN sim >= 0.25 THEN topic END AS topic, coalesce(sim, 0) AS sim FROM t LEFT JOIN b USING (id))
SELECT topic, count(*) AS n, round(avg(sim), 6) AS mean, round(var_pop(sim) * count(*), 6) AS m2, count(*) >= 2 AND avg(sim) >= 0.35 AS active FROM a GROUP BY topic""")
def l16_topics(spark, sf_dir):
    """Texts assigned to a frozen topic catalogue by shared words, and each topic's running statistics."""
    t = sm.unique(records(spark, sf_dir).where("role = 'user'"), "ns", "content").select("id", tx.lexical_terms(F.col("content")).alias("terms"))
    c = sm.unique(table(spark, sf_dir, "benchmark").withColumnRenamed("item_id", "id"), "text").select("id", tx.lexical_terms(F.col("text")).alias("terms"))
    m = sm.sharing(t, c).withColumn("sim", F.col("shared") / F.least("n", "m"))
    place = F.when(F.col("other").isNotNull(), F.struct(F.round("sim", 9), -F.col("other")))
    b = m.groupBy("id").agg(F.max_by("other", place).alias("best"), F.max("sim").alias("sim"))
    a = t.select("id.id").join(b, "id", "left").select(F.when(F.col("sim") >= 0.25, F.col("best")).alias("topic"), F.coalesce("sim", F.lit(0.0)).alias("sim"))
    return a.groupBy("topic").agg(F.count("*").alias("n"), F.round(F.avg("sim"), 6).alias("mean"), F.round(F.var_pop("sim") * F.count("*"), 6).alias("m2"), ((F.count("*") >= 2) & (F.avg("sim") >= 0.35)).alias("active"))


@register(f"""WITH {RECORDS}, p AS (SELECT *, CASE WHEN turn % 4 = 1 THEN 'prefer tabs' WHEN turn % 4 = 2 THEN 'continue' ELSE content END AS c FROM records WHERE role = 'user'),
t AS (SELECT id, ns, turn, c, {_WORDS.format('c')} AS ts FROM p), l AS (SELECT *, lag(ts) OVER (PARTITION BY ns ORDER BY turn) AS before FROM t),
n AS (SELECT *, CASE WHEN before IS NULL OR NOT (c = 'continue' OR coalesce(len(list_intersect(ts, before)) / nullif(len(ts) + len(before) - len(list_intersect(ts, before)), 0), 0) >= 0.3) THEN 1 ELSE 0 END AS fresh FROM l)
SELECT id, CAST(sum(fresh) OVER (PARTITION BY ns ORDER BY turn) AS BIGINT) AS task FROM n""")
def l19_task_identity(spark, sf_dir):
    """A prompt goes on with the task before it if it says so or shares enough words; else it starts one."""
    c = F.when(F.col("turn") % 4 == 1, "prefer tabs").when(F.col("turn") % 4 == 2, "continue").otherwise(F.col("content"))
    w = Window.partitionBy("ns").orderBy("turn")
    t = records(spark, sf_dir).where("role = 'user'").select("id", "ns", "turn", c.alias("c"), tx.lexical_terms(c).alias("ts")).withColumn("before", F.lag("ts").over(w))
    same = F.col("before").isNotNull() & ((F.col("c") == "continue") | (tx.jaccard(F.col("ts"), F.col("before")) >= 0.3))
    return t.withColumn("fresh", (~same).cast("long")).select("id", F.sum("fresh").over(w).alias("task"))


@register("""WITH f AS (SELECT event_id, user_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events)
SELECT event_id, user_id, CAST(sum(CASE WHEN before IS NULL OR before <> event_type THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) AS revision FROM f""")
def l20_snapshot_revision(spark, sf_dir):
    """A new revision whenever the fingerprint of a user's context changes."""
    w = Window.partitionBy("user_id").orderBy("event_id")
    e = table(spark, sf_dir, "events").withColumn("before", F.lag("event_type").over(w))
    new = F.when(F.col("before").isNull() | (F.col("before") != F.col("event_type")), 1).otherwise(0)
    return e.withColumn("new", new).select("event_id", "user_id", F.sum("new").over(w).alias("revision"))


@register(f"""WITH {EPISODES}, t AS (SELECT user_id, day, bool_or(kind = 'verification') AS verified, arg_max(failed, seq) AS failed, arg_max(CASE WHEN kind = 'verification' THEN event_id END, seq) AS evidence FROM episode_events GROUP BY ALL)
SELECT user_id, day, CASE WHEN failed THEN 'failed' WHEN verified THEN 'passed' ELSE 'skipped' END AS outcome, sha256(concat(user_id, ':', day)) AS outcome_id FROM t""")
def l21_episode_outcomes(spark, sf_dir):
    """Outcomes of episodes with deterministic ids; a pass needs verified evidence."""
    t = episode_events(spark, sf_dir).groupBy("user_id", "day").agg(F.bool_or(F.col("kind") == "verification").alias("verified"), F.max_by("failed", "seq").alias("failed"))
    return t.select("user_id", "day", F.when(F.col("failed"), "failed").when(F.col("verified"), "passed").otherwise("skipped").alias("outcome"), F.sha2(F.concat_ws(":", F.col("user_id").cast("string"), F.col("day").cast("string")), 256).alias("outcome_id"))


@register(f"""WITH {EPISODES}, p AS (SELECT user_id, day, unnest([min(event_id), max(event_id) + CAST(user_id % 3 = 0 AS INT)]) AS cited, day(day) % 2 = 0 AS strict FROM episode_events GROUP BY user_id, day),
j AS (SELECT p.user_id, p.day, strict, e.event_id IS NOT NULL AS found, coalesce(e.kind = 'verification', FALSE) AS verified FROM p LEFT JOIN episode_events e ON e.user_id = p.user_id AND e.day = p.day AND e.event_id = cited)
SELECT user_id, day, bool_and(found) AND (NOT any_value(strict) OR bool_or(verified)) AS valid FROM j GROUP BY user_id, day""")
def l22_cited_evidence(spark, sf_dir):
    """Every cited id is in the episode's digest, and where it is asked for one of them is verified."""
    e = episode_events(spark, sf_dir).select("user_id", "day", "event_id", (F.col("kind") == "verification").alias("verified"))
    p = e.groupBy("user_id", "day").agg(F.min("event_id").alias("a"), F.max("event_id").alias("b")).select("user_id", "day", F.explode(F.array("a", F.col("b") + (F.col("user_id") % 3 == 0).cast("int"))).alias("event_id"))
    j = p.join(e, ["user_id", "day", "event_id"], "left")
    strict = F.any_value(F.dayofmonth("day")) % 2 == 0
    return j.groupBy("user_id", "day").agg((F.bool_and(F.col("verified").isNotNull()) & (~strict | F.bool_or(F.coalesce("verified", F.lit(False))))).alias("valid"))
