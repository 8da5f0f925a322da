"""Streams with typed state, over several triggers, against the same rules in one go."""

import random

from recallgrid.streaming import folds, stateful


def stream_of(spark, rows, kinds, folder, parts):
    """A stream over ``parts`` files, one a trigger."""
    for i in range(parts):
        spark.createDataFrame(rows[i * len(rows) // parts : (i + 1) * len(rows) // parts], kinds).coalesce(1).write.parquet(f"{folder}/{i}")
    schema = spark.read.parquet(f"{folder}/0").schema
    return lambda s: s.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(folder))


def test_stale_revisions_are_told_over_triggers(spark, tmp_path):
    rows = [(1, 0, 5, "a"), (1, 1, 4, "late"), (2, 2, 1, "b"), (1, 3, 6, None), (1, 4, 6, "again"), (2, 5, 1, "same"), (1, 6, 7, "back"), (3, 7, 0, "zero")]
    source = stream_of(spark, rows, "key long, n long, revision long, status string", tmp_path / "in", 4)
    got = stateful.drained(spark, lambda s: stateful.stateful(source(s), stateful.Upserts(), "key"), "upserts")
    assert [r["outcome"] for r in sorted(got.collect(), key=lambda r: r["n"])] == ["stored", "stale", "stored", "removed", "stale", "stale", "stored", "stored"]
    assert {r["batch"] for r in got.collect()} == {0, 1, 2, 3}


def test_recent_buffer_of_a_turn(spark, tmp_path):
    random.seed(2)
    rows = [(n % 3, n, n // 60, n, [f"f{random.randint(0, 9)}" for _ in range(random.randint(0, 3))], None if n % 5 == 0 else [f"s{n}"]) for n in range(150)]
    source = stream_of(spark, rows, "user_id long, n long, turn long, event_id long, files array<string>, symbols array<string>", tmp_path / "in", 3)
    got = stateful.drained(spark, lambda s: stateful.stateful(source(s), stateful.RecentBuffer(events=7, files=10, symbols=12), "user_id"), "recent")
    for batch in range(3):
        seen = [r for r in rows if r[1] < 50 * (batch + 1)]
        for r in got.where(f"batch = {batch}").collect():
            own = [x for x in seen if x[0] == r["user_id"]]
            assert r["turn"] == own[-1][2] and list(r["events"]) == [x[3] for x in own if x[2] == r["turn"]][-7:]
            assert list(r["files"]) == [f for x in own for f in x[4]][-10:] and list(r["symbols"]) == [s for x in own for s in x[5] or []][-12:]


def test_working_state_is_typed_and_equals_the_batch(spark, tmp_path):
    random.seed(3)
    kinds = ["goal", "steering", "hypothesis", "recall", "tool_result", "verification", "tool_call"]
    rows = [(u, s, u * 100 + s, random.choice(kinds), random.random() < 0.4, f"tool{random.randint(0, 2)} err", random.choice([None, 1, 2]), random.choice([None, 1, 2]), random.choice([None, u * 100 + s - 1])) for s in range(60) for u in range(4)]
    names = "user_id long, seq int, event_id long, kind string, failed boolean, text string, task long, call long, target long"
    raw = stream_of(spark, rows, names, tmp_path / "in", 3)
    source = lambda s: raw(s).selectExpr("user_id", "date'2024-01-01' AS day", "seq", "event_id", "kind", "failed", "text", "task", "call", "target")
    got = stateful.drained(spark, lambda s: stateful.stateful(source(s), stateful.WorkingState(), "user_id", "day"), "states")
    last = {r["user_id"]: tuple(r)[:-1] for r in sorted(got.collect(), key=lambda r: r["batch"])}
    batch = spark.read.option("recursiveFileLookup", True).parquet(str(tmp_path / "in")).selectExpr("user_id", "date'2024-01-01' AS day", "seq", "event_id", "kind", "failed", "text", "task", "call", "target")
    assert last == {r["user_id"]: tuple(r) for r in folds.working_states(batch).collect()} and len(last) == 4
