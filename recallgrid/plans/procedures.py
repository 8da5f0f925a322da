"""Queries: capsules, procedures and topics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import ranking as rk
from ..operators import similarity as sm
from .registry import register
from .tables import RECORDS, records, table
from .text import _WORDS, _stable

_TOKENS = "greatest(1, list_sum([CAST(ceil(length(w) / 4) AS BIGINT) FOR w IN regexp_extract_all(content, '[0-9A-Za-z_]+')]) + length(regexp_replace(content, '[0-9A-Za-z_\\s]', '', 'g')))"


@register(f"""WITH {RECORDS}, p AS (SELECT *, list_filter(regexp_split_to_array(lower(content), '[^\\p{{L}}\\p{{N}}_./:-]+'), lambda t: length(t) > 1) AS every FROM records), t AS (SELECT id, ns, turn, authority, ts, list_slice(list_filter(every, lambda x, i: list_position(every, x) = i), 1, 128) AS terms, sha256(lower(content)) AS print, {_TOKENS} AS tokens FROM p), q AS (SELECT id AS query_id, ns, turn AS qt, terms AS qs FROM t WHERE turn % 3 = 0 AND len(terms) > 0),
c AS (SELECT query_id, id, ts, print, tokens, len(list_intersect(qs, terms)) * 10 + 4.0 * len(list_intersect(qs, terms)) / greatest(1, least(len(qs), len(terms))) + authority / 100 AS score FROM q JOIN t USING (ns) WHERE turn < qt),
d AS (SELECT * FROM c WHERE score >= 10 QUALIFY row_number() OVER (PARTITION BY query_id, print ORDER BY round(score, 9) DESC, ts DESC, id) = 1),
s AS (SELECT *, row_number() OVER w AS rank, sum(tokens) OVER w AS spent FROM d WINDOW w AS (PARTITION BY query_id ORDER BY round(score, 9) DESC, ts DESC, id ROWS UNBOUNDED PRECEDING))
SELECT query_id, id, round(score, 6) AS score, rank, CAST(spent AS BIGINT) AS spent FROM s WHERE rank <= 12 AND spent <= 800""")
def r28_capsule_selection(spark, sf_dir):
    """For a turn, the earlier turns of its conversation by shared terms, each text once: the leading ones up to 12
    entries and 800 tokens."""
    r = records(spark, sf_dir)
    t = r.select("id", "ns", "turn", "authority", "ts", F.slice(tx.terms(F.col("content")), 1, 128).alias("terms"), F.sha2(F.lower("content"), 256).alias("print"), tx.model_tokens(F.col("content")).alias("tokens"))
    t = t.withColumn("at", F.col("turn"))
    q = t.where((F.col("turn") % 3 == 0) & (F.size("terms") > 0)).select(F.col("id").alias("query_id"), "ns", "at", "terms")
    m = sm.strongest(q, t, 12, of="print", within=["ns"], only="when < at")  # a shared term outweighs all else, so no entry is lost
    c = m.join(q.select("query_id", F.size("terms").alias("n")), "query_id").join(t, "id")
    score = F.col("shared") * 10 + 4.0 * F.col("shared") / F.greatest(F.lit(1), F.least(F.col("n"), F.size("terms"))) + F.col("authority") / 100
    c = c.withColumn("score", F.round(score, 9)).where("score >= 10")
    order = [F.desc("score"), F.desc("ts"), "id"]
    c = c.withColumn("n", F.row_number().over(Window.partitionBy("query_id", "print").orderBy(*order))).where("n = 1")
    w = Window.partitionBy("query_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    c = c.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).withColumn("spent", F.sum("tokens").over(w))
    return c.where("rank <= 12 AND spent <= 800").select("query_id", "id", F.round("score", 6).alias("score"), "rank", "spent")


@register(f"""WITH {RECORDS}, c AS (SELECT ns, id, 80 + turn % 20 AS authority, ts, 'procedure' AS kind, 1 AS p FROM records WHERE turn % 6 = 0 UNION ALL SELECT ns, id, authority, ts, 'profile', 2 FROM records WHERE role = 'user' UNION ALL SELECT ns, id, authority + 1, ts, 'memory', 3 FROM records),
d AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY ns, id ORDER BY p) = 1) SELECT ns, id, kind, authority, row_number() OVER (PARTITION BY ns ORDER BY authority DESC, ts DESC, id) AS place FROM d QUALIFY place <= 96""")
def r29_capsule_build(spark, sf_dir):
    """Procedures, profile entries and hits merged by id, in this priority; 96 by authority and recency."""
    r = records(spark, sf_dir)
    part = lambda df, authority, kind, p: df.select("ns", "id", authority.alias("authority"), "ts", F.lit(kind).alias("kind"), F.lit(p).alias("p"))
    every = part(r.where("turn % 6 = 0"), 80 + F.col("turn") % 20, "procedure", 1).union(part(r.where("role = 'user'"), F.col("authority"), "profile", 2)).union(part(r, F.col("authority") + 1, "memory", 3))
    kept = every.withColumn("n", F.row_number().over(Window.partitionBy("ns", "id").orderBy("p"))).where("n = 1")
    place = F.row_number().over(Window.partitionBy("ns").orderBy(F.desc("authority"), F.desc("ts"), "id"))
    return kept.select("ns", "id", "kind", "authority", place.alias("place")).where("place <= 96")


#: Words of a prompt that a procedure's fields answer to; fixed values.
REQUIRED = ("required", "mandatory", "must be set", "必填", "必须提供", "必需")
OPTIONAL = ("optional", "可选", "允许缺失")
CONFIG = ("config", "configuration", "配置", "环境变量")
STARTUP = ("startup", "start", "initializ", "启动", "初始化")
MISSING = ("missing", "undefined", "absent", "缺失", "未设置")

_has = lambda words: "(" + " OR ".join(f"contains(prompt, '{w}')" for w in words) + ")"
_ASK = ("fix startup config red", "config value missing, it is required", "slow query small", "optional startup value undefined blue")


@register(f"""WITH q AS (SELECT p_partkey AS prompt_id, p_brand AS scope, ['{"', '".join(_ASK)}'][1 + p_partkey % 4] AS prompt FROM part WHERE p_partkey % 20 = 0),
e AS (SELECT p_partkey AS id, p_brand AS scope, p_size % 2 = 0 AS config, p_size % 3 = 0 AS init, p_size % 5 = 0 AS missing, ['optional', 'required', 'other'][1 + p_partkey % 3] AS role, string_split(p_name, ' ') AS terms, p_size AS updated, p_partkey % 90 AS authority FROM part WHERE p_type <> 'SMALL'),
j AS (SELECT *, {_has(REQUIRED)} AS req, {_has(OPTIONAL)} AS opt FROM q JOIN e USING (scope)),
s AS (SELECT prompt_id, id, updated, authority, CASE WHEN config AND {_has(CONFIG)} THEN 24 ELSE 0 END + CASE WHEN init AND {_has(STARTUP)} THEN 18 ELSE 0 END + CASE WHEN missing AND {_has(MISSING)} THEN 12 ELSE 0 END + CASE WHEN req OR opt THEN 8 ELSE 0 END
 + least(20, 4 * len(list_intersect(list_distinct(terms), regexp_split_to_array(prompt, '[^a-z]+')))) AS score FROM j WHERE NOT (role = 'optional' AND req) AND NOT (role = 'required' AND opt))
SELECT prompt_id, id, round(score + authority / 100, 2) AS score FROM s WHERE score >= 24 QUALIFY row_number() OVER (PARTITION BY prompt_id ORDER BY score + authority / 100 DESC, updated DESC, id) = 1""")
def r30_procedure_selection(spark, sf_dir):
    """The most applicable promoted procedure of a prompt's scope, if its fields and terms score 24 or more. Prompts of one scope and
    text are answered once."""
    p = table(spark, sf_dir, "part")
    k, s = F.col("p_partkey"), F.col("p_size")
    q = p.where(k % 20 == 0).select(k.alias("prompt_id"), "p_brand", F.element_at(F.array(*map(F.lit, _ASK)), (1 + k % 4).cast("int")).alias("prompt"))
    role = F.element_at(F.array(*map(F.lit, ("optional", "required", "other"))), (1 + k % 3).cast("int"))
    e = p.where("p_type <> 'SMALL'").select(k.alias("id"), "p_brand", (s % 2 == 0).alias("config"), (s % 3 == 0).alias("init"), (s % 5 == 0).alias("missing"), role.alias("role"), F.array_distinct(F.split("p_name", " ")).alias("terms"), s.alias("updated"), (k % 90).alias("authority"))
    has = lambda words: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(F.col("prompt"), w))
    required, optional = has(REQUIRED), has(OPTIONAL)
    points = lambda on, words, n: F.when(F.col(on) & has(words), n).otherwise(0)
    score = points("config", CONFIG, 24) + points("init", STARTUP, 18) + points("missing", MISSING, 12) + F.when(required | optional, 8).otherwise(0)
    score = score + F.least(F.lit(20), 4 * F.size(F.array_intersect("terms", F.split("prompt", "[^a-z]+"))))
    j = q.select("p_brand", "prompt").distinct().join(e, "p_brand").where(~((F.col("role") == "optional") & required) & ~((F.col("role") == "required") & optional)).withColumn("base", score).where("base >= 24")
    j = j.withColumn("score", F.round(F.col("base") + F.col("authority") / 100, 2))
    best = j.withColumn("n", F.row_number().over(Window.partitionBy("p_brand", "prompt").orderBy(F.desc("score"), F.desc("updated"), "id"))).where("n = 1")
    return q.join(best.select("p_brand", "prompt", "id", "score"), ["p_brand", "prompt"]).select("prompt_id", "id", "score")


#: Spellings of a field's value and the value they stand for; fixed values.
ALIASES = {
    "configuration": "config",
    "config_initialization": "initialization_failure",
    "initialization_failed": "initialization_failure",
    "init_failure": "initialization_failure",
    "missing": "value_missing",
    "missing_value": "value_missing",
    "absent_value": "value_missing",
    "undefined_value": "value_missing",
    "optional_value": "optional",
    "required_value": "required",
    "default": "fallback",
    "use_default": "fallback",
    "default_fallback": "fallback",
    "validation_error": "reject",
    "fail_fast": "reject",
}
FIELDS = {"domain": ("Configuration", "config", "network "), "failure": ("init failure", "initialization-failed", "timeout"), "trigger": ("Missing", "undefined value", "null"), "role": ("optional value", "Required", "n/a"), "behavior": ("use default", "fail-fast", "retry")}
_pick = {name: f"['{"', '".join(v)}'][1 + (p_partkey // {3**i}) % 3]" for i, (name, v) in enumerate(FIELDS.items())}
_canon = lambda x: f"substr(trim(regexp_replace(lower(trim({x})), '[^\\p{{L}}\\p{{N}}]+', '_', 'g'), '_'), 1, 80)"
_alias = lambda x: f"coalesce(map {{{', '.join(f"'{a}': '{b}'" for a, b in ALIASES.items())}}}[{x}], {x})"
_FAMILY = f"""f AS (SELECT p_partkey, p_brand, {', '.join(f"{_alias(_canon(x))} AS {name}" for name, x in _pick.items())} FROM part),
g AS (SELECT *, domain = 'config' AND failure = 'initialization_failure' AND role IN ('optional', 'required') AS known FROM f),
c AS (SELECT p_partkey, p_brand, domain, failure, role, CASE WHEN known THEN 'value_missing' ELSE "trigger" END AS why, CASE WHEN known AND role = 'optional' THEN 'fallback' WHEN known THEN 'reject' ELSE behavior END AS does FROM g)"""


def families(parts):
    """parts with the canonical fields of their families and the key."""
    aliases = F.create_map(*(F.lit(x) for pair in ALIASES.items() for x in pair))
    out = parts
    for i, (name, values) in enumerate(FIELDS.items()):
        raw = F.element_at(F.array(*map(F.lit, values)), (1 + F.floor(F.col("p_partkey") / 3**i) % 3).cast("int"))
        plain = F.substring(F.regexp_replace(F.regexp_replace(F.lower(F.btrim(tx.nfkc(raw))), r"[^\p{L}\p{N}]+", "_"), "^_+|_+$", ""), 1, 80)
        out = out.withColumn(name, plain).withColumn(name, F.coalesce(aliases[F.col(name)], F.col(name)))
    known = (F.col("domain") == "config") & (F.col("failure") == "initialization_failure") & F.col("role").isin("optional", "required")
    out = out.withColumn("why", F.when(known, "value_missing").otherwise(F.col("trigger"))).withColumn("does", F.when(known & (F.col("role") == "optional"), "fallback").when(known, "reject").otherwise(F.col("behavior")))
    return out.withColumn("family", tx.stable_hash("procedure-family:v1", *(F.col(c) for c in ("domain", "failure", "why", "role", "does"))))


@register(f"""WITH {_FAMILY} SELECT p_brand AS scope, {_stable('procedure-family:v1', 'domain', 'failure', 'why', 'role', 'does')} AS family, count(*) AS members, min(p_partkey) AS first FROM c GROUP BY ALL""")
def l13_families(spark, sf_dir):
    """Families of procedures by canonical fields and their aliases, merged inside a scope."""
    return families(table(spark, sf_dir, "part")).groupBy(F.col("p_brand").alias("scope"), "family").agg(F.count("*").alias("members"), F.min("p_partkey").alias("first"))


@register("""WITH t AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 11 = 0 THEN lower(p_brand) END AS explicit, CASE WHEN p_partkey % 5 = 0 THEN p_brand END AS active, CASE WHEN p_partkey % 7 <> 0 THEN p_name END AS label, CASE WHEN p_size % 9 <> 0 THEN p_size / 50 END AS best FROM part)
SELECT id, CASE WHEN explicit IS NOT NULL THEN CASE WHEN explicit = lower(active) THEN 'reuse:explicit_topic_matches_active' ELSE 'new_candidate:user_explicit_topic' END WHEN active IS NOT NULL THEN 'reuse:active_memory_topic' WHEN best IS NULL THEN 'pending:insufficient_topic_evidence'
 WHEN best >= 0.7 THEN 'reuse:calibrated_high_match' WHEN best >= 0.35 THEN 'pending:ambiguous_vector_match' WHEN label IS NULL THEN 'pending:no_stable_topic_label' ELSE 'new_candidate:below_calibrated_low' END AS resolution,
CASE WHEN explicit IS NOT NULL THEN 1.0 WHEN active IS NULL AND best < 0.35 AND label IS NOT NULL THEN greatest(0, 1 - best) END AS confidence FROM t""")
def l18_topic_resolution(spark, sf_dir):
    """A topic by its label, by what is active, or by the best match against a calibrated low and high bound."""
    k, s = F.col("p_partkey"), F.col("p_size")
    t = table(spark, sf_dir, "part").select(k.alias("id"), F.when(k % 11 == 0, F.lower("p_brand")).alias("explicit"), F.when(k % 5 == 0, F.col("p_brand")).alias("active"), F.when(k % 7 != 0, F.col("p_name")).alias("label"), F.when(s % 9 != 0, s / 50).alias("best"))
    explicit, active, best = F.col("explicit"), F.col("active"), F.col("best")
    named = F.when(explicit == F.lower(active), "reuse:explicit_topic_matches_active").otherwise("new_candidate:user_explicit_topic")
    kind = F.when(explicit.isNotNull(), named).when(active.isNotNull(), "reuse:active_memory_topic").when(best.isNull(), "pending:insufficient_topic_evidence")
    kind = kind.when(best >= 0.7, "reuse:calibrated_high_match").when(best >= 0.35, "pending:ambiguous_vector_match").when(F.col("label").isNull(), "pending:no_stable_topic_label").otherwise("new_candidate:below_calibrated_low")
    sure = F.when(explicit.isNotNull(), 1.0).when(active.isNull() & (best < 0.35) & F.col("label").isNotNull(), F.greatest(F.lit(0.0), 1 - best))
    return t.select("id", kind.alias("resolution"), sure.alias("confidence"))


_SHARE = "len(list_intersect(a.ws, b.ws)) / greatest(len(a.ws), len(b.ws), 1)"


@register(f"""WITH {RECORDS}, t AS (SELECT *, {_WORDS.format('content')} AS ws FROM records),
e AS (SELECT a.id, b.id AS ev, b.ns + CAST(a.id % 17 = 0 AS INT) = a.ns AS same, b.role = 'user' AS entailed, b.id % 13 = 0 AS contradicted, b.id % 10 = 3 AS denies, a.id % 7 = 0 AS preference, b.role = 'user' AND b.turn % 2 = 0 AS own, {_SHARE} AS overlap, a.turn % 4 = 1 AS tool, b.authority >= 90 AS verified FROM t a JOIN t b ON a.ns = b.ns AND b.turn BETWEEN a.turn - 2 AND a.turn - 1 WHERE a.role = 'assistant')
SELECT id, count(*) AS evidence, CASE WHEN NOT bool_and(same) THEN 'missing_or_cross_namespace_evidence' WHEN bool_or(contradicted) OR NOT bool_or(entailed) THEN 'candidate_not_entailed_by_evidence' WHEN bool_or(denies) THEN 'candidate_polarity_conflicts_with_evidence' WHEN any_value(preference) AND NOT bool_or(own) THEN 'preference_not_explicit_in_source_evidence'
 WHEN max(overlap) < 0.35 THEN 'candidate_not_grounded_in_evidence' WHEN any_value(tool) AND NOT bool_or(verified) THEN 'unverified_tool_evidence' ELSE 'accepted' END AS reason FROM e GROUP BY id""")
def l2_proposal_gate(spark, sf_dir):
    """L2: proposals against the evidence they cite: namespace, entailment, polarity, preferences in the user's own words,
    words in common, and verified evidence for what a tool says."""
    t = records(spark, sf_dir).withColumn("words", tx.lexical_terms(F.col("content")))
    a = t.where("role = 'assistant'").select("id", "ns", F.explode(F.array(F.col("turn") - 2, F.col("turn") - 1)).alias("turn"), (F.col("id") % 17 != 0).alias("same"), (F.col("id") % 7 == 0).alias("preference"), (F.col("turn") % 4 == 1).alias("tool"), F.col("words").alias("mine"))
    user = F.col("role") == "user"
    b = t.select("ns", "turn", user.alias("entailed"), (F.col("id") % 13 == 0).alias("contradicted"), (F.col("id") % 10 == 3).alias("denies"), (user & (F.col("turn") % 2 == 0)).alias("own"), (F.col("authority") >= 90).alias("verified"), "words")
    j = a.join(b, ["ns", "turn"]).withColumn("overlap", tx.overlap(F.col("mine"), F.col("words")))
    reason = F.when(~F.bool_and("same"), "missing_or_cross_namespace_evidence").when(F.bool_or("contradicted") | ~F.bool_or("entailed"), "candidate_not_entailed_by_evidence").when(F.bool_or("denies"), "candidate_polarity_conflicts_with_evidence")
    reason = reason.when(F.any_value("preference") & ~F.bool_or("own"), "preference_not_explicit_in_source_evidence").when(F.max("overlap") < 0.35, "candidate_not_grounded_in_evidence").when(F.any_value("tool") & ~F.bool_or("verified"), "unverified_tool_evidence")
    return j.groupBy("id").agg(F.count("*").alias("evidence"), reason.otherwise("accepted").alias("reason"))
