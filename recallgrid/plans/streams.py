"""Queries: stream jobs, and the batch form of the working state."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..sources.shared import written
from ..streaming import folds
from ..streaming import stateful as st
from .registry import register
from .tables import EPISODES, episode_events, table


_SESSION = f"""{EPISODES}, e AS (SELECT user_id, day, seq, event_id, CASE WHEN event_type = 'signup' THEN CASE WHEN event_id % 3 = 0 THEN 'steering' ELSE 'goal' END WHEN event_type = 'view' AND event_id % 5 = 0 THEN 'hypothesis' WHEN event_type = 'view' AND event_id % 7 = 0 THEN 'recall' ELSE kind END AS kind,
CASE WHEN event_type = 'purchase' THEN event_id % 4 = 0 ELSE failed END AS failed, CASE WHEN event_type = 'signup' THEN ['continue with it', 'always use tabs', 'build the thing', 'next step shall wait'][1 + event_id % 4] WHEN event_type = 'view' THEN 'file' || CAST(event_id % 6 AS VARCHAR) ELSE 'tool' || CAST(event_id % 3 AS VARCHAR) || ' failed err' || CAST(event_id % 2 AS VARCHAR) END AS text,
CASE WHEN event_type = 'signup' AND event_id % 2 = 0 THEN event_id % 8 END AS task, CASE WHEN event_type IN ('error', 'purchase') AND event_id % 5 < 3 THEN event_id % 5 END AS call, CASE WHEN event_type = 'purchase' AND event_id % 6 = 1 THEN lag(event_id) OVER (PARTITION BY user_id, day ORDER BY seq) END AS target FROM episode_events)"""


def session_events(spark, sf_dir):
    """Events of episodes with texts and named ids, all derived from their numbers."""
    e = episode_events(spark, sf_dir)
    i, t = F.col("event_id"), F.col("event_type")
    kind = F.when(t == "signup", F.when(i % 3 == 0, "steering").otherwise("goal")).when((t == "view") & (i % 5 == 0), "hypothesis").when((t == "view") & (i % 7 == 0), "recall").otherwise(F.col("kind"))
    goal = F.element_at(F.array(*map(F.lit, ("continue with it", "always use tabs", "build the thing", "next step shall wait"))), (1 + i % 4).cast("int"))
    tool = F.concat(F.lit("tool"), (i % 3).cast("string"), F.lit(" failed err"), (i % 2).cast("string"))
    text = F.when(t == "signup", goal).when(t == "view", F.concat(F.lit("file"), (i % 6).cast("string"))).otherwise(tool)
    before = F.lag("event_id").over(Window.partitionBy("user_id", "day").orderBy("seq"))
    return e.select(
        "user_id", "day", "seq", "event_id", kind.alias("kind"), F.when(t == "purchase", i % 4 == 0).otherwise(F.col("failed")).alias("failed"), text.alias("text"),
        F.when((t == "signup") & (i % 2 == 0), i % 8).alias("task"), F.when(t.isin("error", "purchase") & (i % 5 < 3), i % 5).alias("call"), F.when((t == "purchase") & (i % 6 == 1), before).alias("target"),
    )


_TOUCH = lambda name, most, on: f"CASE WHEN {on} THEN list_slice(list_append({name}, e.event_id), -{most}, NULL) ELSE {name} END"
_BARE = lambda x: f"list_filter(regexp_split_to_array(lower({x}), '[^a-z0-9_-]+'), lambda w: length(w) > 1)"
_FAILED_LOOP = "{'id': e.event_id, 'call': CASE WHEN e.kind = 'tool_result' THEN e.call END, 'text': CASE WHEN e.kind = 'tool_result' THEN 'resolve ' ELSE 'fix failing verification: ' END || e.text}"


_STATES = f"""WITH RECURSIVE {_SESSION}, f AS (SELECT user_id, day, CAST(0 AS BIGINT) AS seq, CAST(NULL AS BIGINT) AS task, CAST(NULL AS BIGINT) AS goal, CAST([] AS BIGINT[]) AS decisions, CAST([] AS BIGINT[]) AS confirmed, CAST([] AS BIGINT[]) AS hypotheses, CAST([] AS STRUCT(id BIGINT, call BIGINT, text VARCHAR)[]) AS loops, CAST([] AS BIGINT[]) AS outcomes, CAST([] AS VARCHAR[]) AS resources, CAST([] AS BIGINT[]) AS recalled FROM (SELECT DISTINCT user_id, day FROM e)
UNION ALL SELECT user_id, day, seq, task, CASE WHEN e_kind = 'steering' OR (e_kind = 'goal' AND (goal IS NULL OR moved OR NOT regexp_matches(e_text, '^(continue|next|also)'))) THEN e_id ELSE goal END, CASE WHEN e_kind = 'goal' AND (contains(e_text, 'always use') OR contains(e_text, 'shall')) THEN list_append(CASE WHEN moved THEN [] ELSE decisions END, e_id)[-24:] WHEN moved THEN [] ELSE decisions END,
 CASE WHEN moved THEN [] WHEN passed THEN list_append(confirmed, e_id)[-24:] ELSE confirmed END, CASE WHEN moved OR e_kind = 'steering' THEN [] WHEN e_kind = 'hypothesis' THEN list_append(hypotheses, e_id)[-12:] ELSE hypotheses END,
 CASE WHEN moved THEN [] WHEN opens THEN list_append(loops, made)[-16:] WHEN passed THEN list_filter(loops, lambda x: NOT (coalesce(x.id = e_target, FALSE) OR coalesce(x.call = e_call, FALSE) OR len(list_intersect({_BARE('e_text')}, {_BARE('x.text')})) >= 0.6 * len(list_distinct({_BARE('e_text')})))) ELSE loops END,
 CASE WHEN moved THEN [] WHEN e_kind IN ('tool_result', 'verification') THEN list_append(outcomes, e_id)[-20:] ELSE outcomes END, CASE WHEN e_kind = 'tool_call' THEN list_append(list_filter(resources, lambda x: x <> e_text), e_text)[-24:] ELSE resources END, CASE WHEN e_kind = 'recall' THEN list_append(recalled, e_id)[-64:] ELSE recalled END
 FROM (SELECT f.user_id, f.day, e.seq, CASE WHEN e.kind = 'goal' THEN coalesce(e.task, f.task) ELSE f.task END AS task, goal, decisions, confirmed, hypotheses, loops, outcomes, resources, recalled, e.kind AS e_kind, e.text AS e_text, e.event_id AS e_id, e.target AS e_target, e.call AS e_call, e.kind = 'goal' AND coalesce(f.task <> e.task, FALSE) AS moved,
  e.kind IN ('tool_result', 'verification') AND e.failed AS opens, e.kind = 'verification' AND NOT e.failed AS passed, {_FAILED_LOOP} AS made FROM f JOIN e ON e.user_id = f.user_id AND e.day = f.day AND e.seq = f.seq + 1)),
l AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY user_id, day ORDER BY seq DESC) = 1)
SELECT user_id, day, task, goal, array_to_string(decisions, ',') AS decisions, array_to_string(confirmed, ',') AS confirmed, array_to_string(hypotheses, ',') AS hypotheses, array_to_string(list_transform(loops, lambda x: x.id), ',') AS loops, array_to_string(outcomes, ',') AS outcomes, array_to_string(resources, ',') AS resources, array_to_string(recalled, ',') AS recalled, seq AS seen FROM l"""


def listed(states):
    """The lists of working states as text."""
    text = lambda c, x: F.array_join(F.transform(x, lambda v: v.cast("string")), ",").alias(c)
    return states.select("user_id", "day", "task", "goal", *(text(c, F.col(f"{c}.id") if c == "loops" else F.col(c)) for c in ("decisions", "confirmed", "hypotheses", "loops", "outcomes", "resources", "recalled")), "seen")


@register(_STATES)
def t1_working_state(spark, sf_dir):
    """What a session's events leave: goal and task, decisions, confirmed checks, hypotheses, open loops, outcomes, resources
    and recalled ids."""
    return listed(folds.working_states(session_events(spark, sf_dir)))


def table_stream(spark, sf_dir, name):
    """A table as a stream of its files; the path is a pattern, for a stream takes a single file only so."""
    return spark.readStream.schema(table(spark, sf_dir, name).schema).parquet(f"{sf_dir}/{name}.parque[t]")


@register(_STATES)
def t1_streamed_state(spark, sf_dir):
    """T1 as a stream with typed state, over events that are written to the shared folder first: the last state of each session."""
    events = written(session_events(spark, sf_dir), "events")
    folder = events.inputFiles()[0].rpartition("/")[0]
    states = st.drained(spark, lambda s: st.stateful(s.readStream.schema(events.schema).parquet(folder), st.WorkingState(), "user_id", "day"), "states")
    last = states.groupBy("user_id", "day").agg(F.max_by(F.struct(*(c for c in states.columns if c not in ("user_id", "day"))), "batch").alias("s"))
    return listed(last.select("user_id", "day", "s.*"))


@register("""WITH c AS (SELECT o_custkey AS key, o_orderkey AS n, o_orderkey * 7 % 1000 AS revision, CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END AS status FROM orders), h AS (SELECT *, max(revision) OVER (PARTITION BY key ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS held FROM c)
SELECT key, n, revision, status, CASE WHEN revision <= held THEN 'stale' WHEN status IS NULL THEN 'removed' ELSE 'stored' END AS outcome FROM h""")
def t4_revisioned_upserts(spark, sf_dir):
    """T4: revisioned changes as a stream, each stored or told to be stale."""
    changes = lambda s: table_stream(s, sf_dir, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("n"), (F.col("o_orderkey") * 7 % 1000).alias("revision"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("status"))
    return st.drained(spark, lambda s: st.stateful(changes(s), st.Upserts(), "key"), "upserts").drop("batch")


@register("""WITH c AS (SELECT user_id, event_id, datediff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS turn, CASE WHEN event_type = 'view' THEN ['src/f' || CAST(event_id % 9 AS VARCHAR), 'src/g' || CAST(event_id % 4 AS VARCHAR)] ELSE CAST([] AS VARCHAR[]) END AS files, CASE WHEN event_type = 'click' THEN ['s' || CAST(event_id % 50 AS VARCHAR)] ELSE CAST([] AS VARCHAR[]) END AS symbols FROM events),
l AS (SELECT *, coalesce(turn <> lag(turn) OVER (PARTITION BY user_id ORDER BY event_id), TRUE) AS starts FROM c), r AS (SELECT *, sum(CAST(starts AS INT)) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM l), m AS (SELECT *, max(run) OVER (PARTITION BY user_id) AS last FROM r)
SELECT user_id, arg_max(turn, event_id) AS turn, array_to_string((list(event_id ORDER BY event_id) FILTER (run = last))[-256:], ',') AS events, array_to_string(flatten(list(files ORDER BY event_id))[-64:], ',') AS files, array_to_string(flatten(list(symbols ORDER BY event_id))[-128:], ',') AS symbols FROM m GROUP BY user_id""")
def t5_recent_buffer(spark, sf_dir):
    """T5: as a stream, the last 256 events of each user's turn, and the last 64 files and 128 symbols; a day is a turn."""
    some = lambda kind, *of: F.when(F.col("event_type") == kind, F.array(*of)).otherwise(F.array().cast("array<string>"))
    name = lambda lead, by: F.concat(F.lit(lead), (F.col("event_id") % by).cast("string"))
    turn = F.datediff(F.to_date("ts"), F.lit("1970-01-01")).cast("long").alias("turn")
    events = lambda s: table_stream(s, sf_dir, "events").select("user_id", F.col("event_id").alias("n"), turn, "event_id", some("view", name("src/f", 9), name("src/g", 4)).alias("files"), some("click", name("s", 50)).alias("symbols"))
    kept = st.drained(spark, lambda s: st.stateful(events(s), st.RecentBuffer(), "user_id"), "recent")
    last = kept.groupBy("user_id").agg(F.max_by(F.struct("turn", "events", "files", "symbols"), "batch").alias("s")).select("user_id", "s.*")
    return last.select("user_id", "turn", F.array_join(F.transform("events", lambda x: x.cast("string")), ",").alias("events"), *(F.array_join(c, ",").alias(c) for c in ("files", "symbols")))
