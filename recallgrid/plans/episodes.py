"""Queries: episodes, events, artifacts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import artifacts as af
from ..operators import substrings as ss
from .registry import register
from .tables import EPISODES, episode_events, table


@register(f"""WITH {EPISODES}, c AS (SELECT *, sha256(concat(user_id, ':', day, ':', seq)) AS id, max(CASE WHEN kind = 'tool_call' THEN seq END) OVER (PARTITION BY user_id, day ORDER BY seq) AS call FROM episode_events)
SELECT event_id, seq, id, CASE WHEN kind = 'tool_result' THEN call END AS parent_seq FROM c""")
def e1_sequencing(spark, sf_dir):
    """Numbered events with deterministic ids; a result's parent is the call before it."""
    w = Window.partitionBy("user_id", "day").orderBy("seq")
    key = F.sha2(F.concat_ws(":", F.col("user_id").cast("string"), F.col("day").cast("string"), F.col("seq").cast("string")), 256)
    call = F.max(F.when(F.col("kind") == "tool_call", F.col("seq"))).over(w)
    return episode_events(spark, sf_dir).select("event_id", "seq", key.alias("id"), F.when(F.col("kind") == "tool_result", call).alias("parent_seq"))


_COMMANDS = ("npm test", "eslint lint --fix", "ls -la", "make rebuild", "pytest", "cargo test -q", "echo latest")


@register(f"""WITH calls AS (SELECT conv_id, turn, ['{"', '".join(_COMMANDS)}'][1 + (conv_id + turn) % 7] AS command, CASE WHEN turn % 8 = 6 THEN 'read' ELSE 'bash' END AS tool FROM conversations WHERE role = 'user'),
results AS (SELECT conv_id, turn - 1 AS call, length(text) % 3 = 0 AS is_error FROM conversations WHERE role = 'assistant')
SELECT calls.conv_id, turn, command, CASE WHEN is_error THEN 'failed' ELSE 'passed' END AS status FROM calls JOIN results ON calls.conv_id = results.conv_id AND call = turn WHERE tool = 'bash' AND regexp_matches(command, '{af.VERIFICATION}', 'i')""")
def e2_verifications(spark, sf_dir):
    """Checks by the results of shell commands. A user turn calls a command by number, the turn after it is the result."""
    c = table(spark, sf_dir, "conversations")
    command = F.element_at(F.array(*map(F.lit, _COMMANDS)), (1 + (F.col("conv_id") + F.col("turn")) % 7).cast("int")).alias("command")
    calls = c.where("role = 'user'").select("conv_id", "turn", command, F.when(F.col("turn") % 8 == 6, "read").otherwise("bash").alias("tool"))
    results = c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), (F.char_length("text") % 3 == 0).alias("is_error"))
    return af.verifications(calls, results, "conv_id", "turn")


@register(f"""WITH {EPISODES}, o AS (SELECT user_id, day, max(CASE WHEN kind = 'tool_result' THEN seq * 2 + CAST(failed AS INT) END) % 2 AS err, max(CASE WHEN kind = 'verification' THEN seq END) AS v FROM episode_events GROUP BY ALL)
SELECT user_id, day, CASE WHEN err IS NULL THEN 'unknown' WHEN err = 1 THEN 'failed' ELSE 'succeeded' END AS execution, v IS NOT NULL AS verified, CASE WHEN err = 1 THEN 'failed' WHEN v IS NOT NULL THEN 'passed' ELSE 'unverified' END AS status FROM o""")
def e3_episode_outcomes(spark, sf_dir):
    """Execution by the last result, verification by the last check, and the task's status."""
    result = F.col("kind") == "tool_result"
    o = episode_events(spark, sf_dir).groupBy("user_id", "day").agg(F.max_by(F.when(result, F.col("failed")), F.when(result, F.col("seq"))).alias("err"), F.bool_or(F.col("kind") == "verification").alias("verified"))
    err = F.coalesce("err", F.lit(False))
    return o.select("user_id", "day", F.when(F.col("err").isNull(), "unknown").when(err, "failed").otherwise("succeeded").alias("execution"), "verified", F.when(err, "failed").when(F.col("verified"), "passed").otherwise("unverified").alias("status"))


@register("""WITH d AS (SELECT doc_id, text || CASE WHEN doc_id % 5 = 0 THEN chr(10) || 'Error: boom ' || CAST(doc_id % 3 AS VARCHAR) || chr(10) || 'at src/a' || CAST(doc_id AS VARCHAR) || '.ts' ELSE '' END AS text FROM documents), l AS (SELECT doc_id, text, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '\\b(error|exception|failed)\\b', 'i')) AS errors FROM d)
SELECT doc_id, len(errors) AS error_lines, array_to_string(list_slice(list_filter(errors, lambda x, i: list_position(errors, x) = i), 1, 8), '|') AS key_errors, len(list_slice(list_distinct(regexp_extract_all(text, '[A-Za-z0-9_.-]+/[A-Za-z0-9_./-]+')), 1, 16)) AS paths, least(strlen(text), 2048) AS preview FROM l""")
def e5_result_summary(spark, sf_dir):
    """E5: error lines, key errors and paths of a result."""
    extra = F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("\nError: boom "), (F.col("doc_id") % 3).cast("string"), F.lit("\nat src/a"), F.col("doc_id").cast("string"), F.lit(".ts"))).otherwise("")
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat("text", extra).alias("text"))
    errors = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"(?i)\b(error|exception|failed)\b"))
    paths = F.slice(F.array_distinct(F.regexp_extract_all("text", F.lit("([A-Za-z0-9_.-]+/[A-Za-z0-9_./-]+)"), 1)), 1, 16)
    d = d.withColumn("errors", errors)
    return d.select("doc_id", F.size("errors").alias("error_lines"), F.array_join(F.slice(F.array_distinct("errors"), 1, 8), "|").alias("key_errors"), F.size(paths).alias("paths"), F.least(F.octet_length("text"), F.lit(2048)).alias("preview"))


@register("""WITH r AS (SELECT event_id, user_id, event_type, CAST(floor(value) AS BIGINT) % 3 AS h, lag(CAST(floor(value) AS BIGINT) % 3) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS before FROM events) SELECT event_id, before IS NOT NULL AND before = h AS reference_only FROM r""")
def e6_repeated_reads(spark, sf_dir):
    """A read of the same thing with the same content as the one before."""
    w = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    h = F.floor("value") % 3
    return table(spark, sf_dir, "events").withColumn("h", h).withColumn("before", F.lag("h").over(w)).select("event_id", F.coalesce(F.col("before") == F.col("h"), F.lit(False)).alias("reference_only"))


@register("""WITH a AS (SELECT DISTINCT sha256(text) AS artifact_id, strlen(text) AS n FROM documents) SELECT artifact_id, greatest(1, CAST(ceil(n / 1024) AS BIGINT)) AS chunks, TRUE AS intact FROM a""")
def e8_artifact_audit(spark, sf_dir):
    """Texts as hashed chunks of 1 KiB, each artifact once, and the audit of what was written."""
    return af.audited(af.chunked(table(spark, sf_dir, "documents"), 1024))


@register("""WITH d AS (SELECT DISTINCT sha256(text) AS artifact_id, text FROM documents), h AS (SELECT artifact_id, substr(hex(encode(text)), 1801, 600) AS h FROM d WHERE strlen(text) > 900),
c AS (SELECT artifact_id, regexp_replace(regexp_replace(h, '^((8|9|A|B)[0-9A-F])+', ''), '((C|D)[0-9A-F]|E[0-9A-F](([89AB][0-9A-F])?)|F[0-9A-F](([89AB][0-9A-F]){0,2}))$', '') AS cut, regexp_replace(h, '^((8|9|A|B)[0-9A-F])+', '') AS head FROM h)
SELECT artifact_id, 900 AS start, 300 AS length, decode(unhex(CASE WHEN length(cut) % 2 = 0 THEN cut ELSE head END)) AS text FROM c""")
def e9_byte_ranges(spark, sf_dir):
    """A byte range of every text that reaches over a chunk, cut to whole characters."""
    c = af.chunked(table(spark, sf_dir, "documents"), 1024)
    asked = c.select("artifact_id").distinct().select("artifact_id", F.lit(900).alias("start"), F.lit(300).alias("length"))
    return af.read_ranges(asked, c, 1024)


@register("""WITH q AS (SELECT item_id AS query_id, list_distinct(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '')) AS qs FROM benchmark),
p AS (SELECT query_id, doc_id, text, qs FROM q, documents WHERE len(qs) > 0 AND len(list_filter(qs, lambda x: NOT contains(lower(text), x))) = 0),
c AS (SELECT *, unnest(range(0, CAST(floor((greatest(length(text), 1) - 1) / 600) AS BIGINT) + 1)) AS chunk FROM p), f AS (SELECT *, greatest(0, chunk * 600 - 300) AS first FROM c), r AS (SELECT *, substr(text, first + 1, chunk * 600 + 600 - first) AS part FROM f),
m AS (SELECT *, list_min(list_transform(qs, lambda x: position(x IN lower(part)))) - 1 AS place FROM r WHERE len(list_filter(qs, lambda x: NOT contains(lower(part), x))) = 0),
w AS (SELECT *, greatest(0, place - 240) AS a, least(length(part), place + 760) AS b FROM m QUALIFY row_number() OVER (PARTITION BY query_id, doc_id ORDER BY chunk) <= 8)
SELECT query_id, doc_id, CAST(chunk AS INT) AS chunk, strlen(substr(text, 1, first + a)) AS byte_start, strlen(substr(text, 1, first + b)) AS byte_end, sha256(substr(part, a + 1, b - a)) AS window_hash FROM w""")
def e21_artifact_search(spark, sf_dir):
    """Where a stretch of a text holds all terms of a query, anywhere; texts are read in chunks of 600 characters."""
    q = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return ss.all_terms(q, table(spark, sf_dir, "documents"), 8, size=600, carry=300)


@register(f"""WITH {EPISODES}, c AS (SELECT *, max(CASE WHEN kind = 'tool_call' THEN event_id END) OVER (PARTITION BY user_id, day ORDER BY seq) AS parent FROM episode_events), r AS (SELECT user_id, day, event_id AS id FROM c WHERE failed UNION SELECT user_id, day, parent FROM c WHERE failed AND parent IS NOT NULL),
e AS (SELECT user_id, day, id, event_type || ' ' || props AS text FROM r JOIN events ON event_id = id AND events.user_id = r.user_id), m AS (SELECT user_id, day, id, text FROM e WHERE contains(lower(text), 'error') AND contains(lower(text), CAST(user_id % 10 AS VARCHAR)))
SELECT user_id, day, id, text FROM m QUALIFY row_number() OVER (PARTITION BY user_id, day ORDER BY id) <= 32""".replace("r JOIN events ON event_id = id AND events.user_id = r.user_id", "r JOIN (SELECT event_id, event_type, props FROM events) ON event_id = id"))
def e12_evidence_search(spark, sf_dir):
    """Of an episode's evidence (E11) what holds all terms asked for, 32 matches at most."""
    texts = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.concat_ws(" ", "event_type", "props").alias("text"))
    asked = F.array(F.lit("error"), (F.col("user_id") % 10).cast("string"))
    m = evidence(spark, sf_dir).join(texts, "id").where(F.forall(asked, lambda x: F.contains(F.lower("text"), x)))
    n = F.row_number().over(Window.partitionBy("user_id", "day").orderBy("id"))
    return m.select("user_id", "day", "id", "text", n.alias("n")).where("n <= 32").drop("n")


@register(f"""WITH {EPISODES}, s AS (SELECT *, coalesce(max(CASE WHEN kind = 'goal' THEN seq END) OVER (PARTITION BY user_id, day), 0) AS steer FROM episode_events), a AS (SELECT *, row_number() OVER (PARTITION BY user_id, day ORDER BY seq DESC) AS back FROM s WHERE seq > steer)
SELECT user_id, day, count(*) AS turns, count(*) FILTER (failed) AS failures, bool_or(kind = 'verification') AS verified, string_agg(CASE WHEN back <= 5 THEN CAST(event_id AS VARCHAR) END, ',' ORDER BY seq) AS latest FROM a GROUP BY user_id, day""")
def e14_task_episodes(spark, sf_dir):
    """What an episode's turns since the last steering come to; the last five ids are kept."""
    w = Window.partitionBy("user_id", "day")
    a = episode_events(spark, sf_dir).withColumn("steer", F.coalesce(F.max(F.when(F.col("kind") == "goal", F.col("seq"))).over(w), F.lit(0))).where("seq > steer")
    out = a.withColumn("back", F.row_number().over(w.orderBy(F.desc("seq")))).groupBy("user_id", "day").agg(F.count("*").alias("turns"), F.sum(F.col("failed").cast("long")).alias("failures"), F.bool_or(F.col("kind") == "verification").alias("verified"), F.array_sort(F.collect_list(F.when(F.col("back") <= 5, F.struct("seq", F.col("event_id").cast("string").alias("id"))))).alias("l"))
    return out.select("user_id", "day", "turns", "failures", "verified", F.array_join(F.transform("l", lambda x: x["id"]), ",").alias("latest"))


#: Legal moves of a task's state; fixed values.
MOVES = (("signup", "view"), ("view", "click"), ("view", "error"), ("click", "purchase"), ("click", "error"), ("error", "view"))


@register(f"""WITH s AS (SELECT event_id, user_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events)
SELECT event_id, before || '>' || event_type AS move, before || '>' || event_type IN ({', '.join(f"'{a}>{b}'" for a, b in MOVES)}) AS legal FROM s WHERE before IS NOT NULL""")
def e16_transition_audit(spark, sf_dir):
    """State moves against the table of legal ones."""
    w = Window.partitionBy("user_id").orderBy("event_id")
    s = table(spark, sf_dir, "events").withColumn("before", F.lag("event_type").over(w)).where("before IS NOT NULL")
    move = F.concat_ws(">", "before", "event_type")
    return s.select("event_id", move.alias("move"), move.isin(*(f"{a}>{b}" for a, b in MOVES)).alias("legal"))


def evidence(spark, sf_dir):
    """(user_id, day, id): an episode's failures with the calls that led to them, each once."""
    w = Window.partitionBy("user_id", "day").orderBy("seq")
    c = episode_events(spark, sf_dir).withColumn("parent", F.max(F.when(F.col("kind") == "tool_call", F.col("event_id"))).over(w)).where("failed")
    return c.select("user_id", "day", F.explode(F.array_compact(F.array("event_id", "parent"))).alias("id")).distinct()
