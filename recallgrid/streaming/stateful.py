"""Stateful stream jobs over typed state: revisioned upserts, the recent buffer of a turn, the working state of a session.

Each is a StatefulProcessor for ``transformWithState``; state is kept in RocksDB, as values and lists of declared types, and
goes when its time to live ends or its owner is removed. What a trigger brings for one key is sorted by the arrival
number before it is applied, so a trigger is to be bounded at the source (maxFilesPerTrigger, maxBytesPerTrigger).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..sources.shared import fresh_path
from .folds import STATE, empty_state, reduce_event

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def ordered(rows: Iterator[pd.DataFrame], by: str) -> pd.DataFrame:
    return pd.concat(list(rows)).sort_values(by, kind="stable")


class Upserts(StatefulProcessor):
    """Changes (key, n, revision, status) in order of n: one whose revision isn't above the key's is stale and changes nothing.
    A null status removes the key's value, though its revision stays, so late changes are still told."""

    OUT = "key long, n long, revision long, status string, outcome string"

    def __init__(self, ttl_ms: int | None = None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "revision long", self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = self.last.get()[0] if self.last.exists() else None
        out = []
        for n, revision, status in ordered(rows, "n")[["n", "revision", "status"]].itertuples(index=False):
            stale = held is not None and revision <= held
            out.append((key[0], n, revision, status, "stale" if stale else "removed" if status is None else "stored"))
            held = held if stale else int(revision)
        self.last.update((held,))
        yield pd.DataFrame(out, columns=["key", "n", "revision", "status", "outcome"])

    def close(self) -> None:
        pass


class RecentBuffer(StatefulProcessor):
    """Captured events (user_id, n, turn, event_id, files, symbols) in order of n: the last ``events`` of the turn, and the last
    ``files`` and ``symbols`` of all turns. An event of another turn empties the turn's list."""

    OUT = "user_id long, turn long, events array<long>, files array<string>, symbols array<string>"

    def __init__(self, events: int = 256, files: int = 64, symbols: int = 128, ttl_ms: int | None = None):
        self.most = {"events": events, "files": files, "symbols": symbols}
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.turn = handle.getValueState("turn", "turn long", self.ttl_ms)
        self.lists = {c: handle.getListState(c, f"x {'long' if c == 'events' else 'string'}", self.ttl_ms) for c in self.most}

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        turn = self.turn.get()[0] if self.turn.exists() else None
        held = {c: [x[0] for x in state.get()] for c, state in self.lists.items()}
        for now, event_id, files, symbols in ordered(rows, "n")[["turn", "event_id", "files", "symbols"]].itertuples(index=False):
            if now != turn:
                turn, held["events"] = int(now), []
            new = {"events": [int(event_id)], "files": [] if files is None else list(files), "symbols": [] if symbols is None else list(symbols)}
            held = {c: (held[c] + x)[-self.most[c] :] for c, x in new.items()}
        self.turn.update((turn,))
        for c, state in self.lists.items():
            state.put([(x,) for x in held[c]]) if held[c] else state.clear()
        yield pd.DataFrame([{"user_id": key[0], "turn": turn, **held}])

    def close(self) -> None:
        pass


class WorkingState(StatefulProcessor):
    """The working state of a session (user_id, day), folded from its events in order of seq; one row of it after each trigger. Sessions
    are many and short, so they come and go as rows: a frame for each would take longer than its fold."""

    ROWS = True
    OUT = f"user_id long, day date, {STATE}"

    def __init__(self, ttl_ms: int | None = None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("state", STATE, self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        state, held = empty_state(), self.held.get()
        if held is not None:
            state = {c: list(v) if isinstance(state[c], list) else v for c, v in zip(state, held)}
            state["loops"] = [{"id": x[0], "call": x[1], "text": x[2]} for x in state["loops"]]
        for row in sorted(rows, key=lambda r: r["seq"]):
            state = reduce_event(state, row.asDict())
        self.held.update(tuple([tuple(x.values()) for x in v] if c == "loops" else v for c, v in state.items()))
        yield Row(user_id=key[0], day=key[1], **state)

    def close(self) -> None:
        pass


def stateful(source: DataFrame, processor: StatefulProcessor, *keys: str) -> DataFrame:
    """source, a stream, through the processor by ``keys``. State with a time to live needs processing time, and such a stream
    goes on until it is stopped, for there is always state that may end."""
    time = "ProcessingTime" if processor.ttl_ms is not None else "None"
    groups = source.groupBy(*keys)
    run = groups.transformWithState if getattr(processor, "ROWS", False) else groups.transformWithStateInPandas
    return run(processor, processor.OUT, "Update", time)


def drained(spark: SparkSession, source: Callable[[SparkSession], DataFrame], name: str) -> DataFrame:
    """Runs a stream until its source has no more and reads back what it has put out, with ``batch``, the number of the trigger.
    Output and checkpoint lie in the shared folder, so a restarted job goes on where it stopped."""
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    path = fresh_path(spark, name)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    try:
        stream = source(spark)
        write = lambda rows, batch: rows.write.mode("overwrite").parquet(f"{path}/out/batch={batch}")
        query = stream.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    return spark.read.schema(stream.schema.add("batch", "long")).parquet(f"{path}/out")
