"""Stream jobs and the batch forms of the same reductions."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: How many of each list the working state keeps; fixed values.
KEPT = {"decisions": 24, "confirmed": 24, "hypotheses": 12, "loops": 16, "outcomes": 20, "resources": 24, "recalled": 64}
LOOP = "array<struct<id:long,call:long,text:string>>"
STATE = f"task long, goal long, decisions array<long>, confirmed array<long>, hypotheses array<long>, loops {LOOP}, outcomes array<long>, resources array<string>, recalled array<long>, seen long"
#: What an event brings: its kind, whether it failed, a text, and ids it may name; all but the first two may be null.
EVENT = "user_id long, day date, seq int, event_id long, kind string, failed boolean, text string, task long, call long, target long"


def empty_state() -> dict:
    return {"task": None, "goal": None, "decisions": [], "confirmed": [], "hypotheses": [], "loops": [], "outcomes": [], "resources": [], "recalled": [], "seen": 0}


def _words(text: str | None) -> set[str]:
    return {w for w in re.split(r"[^\w-]+", (text or "").lower()) if len(w) > 1}


def resolves(loop: dict, event: dict) -> bool:
    """Whether a passed check closes a loop: it names the loop's event or its call, or the loop has 0.6 of the check's words."""
    if event["target"] == loop["id"] or (event["call"] is not None and event["call"] == loop["call"]):
        return True
    asked, own = _words(event["text"]), _words(loop["text"])
    return bool(asked and own) and len(asked & own) >= 0.6 * len(asked)


def reduce_event(state: dict, event: dict) -> dict:
    """One event folded into the working state of its session.

    A goal of another task empties the lists; a goal stands for the one before it unless it goes on with it, and one that
    makes a rule is a decision. Steering sets the goal and drops the hypotheses of the model. A tool call names a
    resource, a failed result or check opens a loop, any result or check is an outcome, a passed check is confirmed and
    closes the loops that it resolves. Lists hold no id twice and keep their latest.
    """
    state = dict(state)

    def add(name: str, value) -> None:
        id_of = (lambda x: x["id"]) if name == "loops" else (lambda x: x)
        state[name] = [*(x for x in state[name] if id_of(x) != id_of(value)), value][-KEPT[name] :]

    kind, number, text = event["kind"], event["event_id"], event["text"] or ""
    if kind == "goal":
        moved = state["task"] is not None and event["task"] is not None and event["task"] != state["task"]
        if moved:
            state |= {"decisions": [], "confirmed": [], "hypotheses": [], "loops": [], "outcomes": []}
        if event["task"] is not None:
            state["task"] = event["task"]
        if state["goal"] is None or moved or not text.startswith(("continue", "next", "also")):
            state["goal"] = number
        if "always use" in text or "shall" in text:
            add("decisions", number)
    elif kind == "steering":
        state["goal"], state["hypotheses"] = number, []
    elif kind == "hypothesis":
        add("hypotheses", number)
    elif kind == "recall":
        add("recalled", number)
    elif kind == "tool_call":
        add("resources", text)
    elif kind in ("tool_result", "verification"):
        add("outcomes", number)
        if event["failed"]:
            add("loops", {"id": number, "call": event["call"] if kind == "tool_result" else None, "text": f"resolve {text}" if kind == "tool_result" else f"fix failing verification: {text}"})
        elif kind == "verification":
            add("confirmed", number)
            state["loops"] = [x for x in state["loops"] if not resolves(x, event)]
    state["seen"] += 1
    return state


def _events(frame: pd.DataFrame) -> Iterator[dict]:
    """Rows as dictionaries; missing ids are None."""
    names = ["event_id", "kind", "failed", "text", "task", "call", "target"]
    columns = [[None if x is None or x != x else (int(x) if c in ("event_id", "task", "call", "target") else x) for x in frame[c].tolist()] for c in names]
    for values in zip(*columns):
        yield dict(zip(names, values))


def working_states(events: DataFrame) -> DataFrame:
    """(user_id, day, *STATE) of events (see EVENT), a session for each user and day. Events of a session stream by in order;
    no session is held in memory."""

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, empty_state()
        for batch in batches:
            done = []
            for user, day, event in zip(batch["user_id"].tolist(), batch["day"].tolist(), _events(batch)):
                if (user, day) != key:
                    if key is not None:
                        done.append({"user_id": key[0], "day": key[1], **state})
                    key, state = (user, day), empty_state()
                state = reduce_event(state, event)
            if done:
                yield pd.DataFrame(done)
        if key is not None:
            yield pd.DataFrame([{"user_id": key[0], "day": key[1], **state}])

    ordered = events.repartition("user_id", "day").sortWithinPartitions("user_id", "day", "seq")
    return ordered.mapInPandas(fold, f"user_id long, day date, {STATE}")


def stream_ewma(metrics: DataFrame, columns: tuple[str, ...], alpha: float = 0.25) -> DataFrame:
    """(policy, *columns) after each trigger: weighted means of a stream of (policy, day, *columns), in order of the day."""
    kinds = ", ".join(f"{c} double" for c in columns)

    def fold(key, groups, held):
        means = list(held.get) if held.exists else None
        for row in pd.concat(list(groups)).sort_values("day")[list(columns)].itertuples(index=False):
            means = list(map(float, row)) if means is None else [alpha * float(x) + (1 - alpha) * m for x, m in zip(row, means)]
        held.update(tuple(means))
        yield pd.DataFrame([{"policy": key[0], **dict(zip(columns, means))}])

    return metrics.groupBy("policy").applyInPandasWithState(fold, f"policy long, {kinds}", kinds, "update", "NoTimeout")


def latest_revisions(changes: DataFrame, key: str, revision: str, *columns: str) -> DataFrame:
    """The row of each key with the highest revision: what a batch of revisioned upserts leaves."""
    last = changes.groupBy(key).agg(F.max_by(F.struct(revision, *columns), F.col(revision)).alias("last"))
    return last.select(key, "last.*")


def upsert_batch(path: str, key: str, revision: str, *columns: str, parts: int = 64):
    """For foreachBatch: merges a micro-batch into the table at ``path``; rows with a revision not above the stored one are stale.

    The table is laid out by ``parts`` hashes of the key. A batch reads and rewrites only the parts that it touches, beside
    their earlier versions, and a batch that is run again writes the same. read_upserts takes each part's latest.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        part = F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")
        new = latest_revisions(batch, key, revision, *columns).withColumn("part", part)
        touched = new.select("part").distinct()
        old = read_upserts(spark, path, before=batch_id)
        if old is not None:
            new = latest_revisions(old.join(touched, "part", "left_semi").drop("part", "version").unionByName(new.drop("part")), key, revision, *columns).withColumn("part", part)
        new.repartition("part").write.mode("overwrite").partitionBy("part").parquet(f"{path}/version={batch_id}")

    return write


def read_upserts(spark, path: str, before: int | None = None) -> DataFrame | None:
    """The table that upsert_batch keeps, up to a version: of each part the rows of its latest; None if there is none yet."""
    try:
        stored = spark.read.parquet(path)
    except AnalysisException:
        return None
    if before is not None:
        stored = stored.where(F.col("version") < before)
    latest = stored.groupBy("part").agg(F.max("version").alias("version"))  # a row a part, from the folders' names
    return stored.join(F.broadcast(latest), ["part", "version"], "left_semi")
