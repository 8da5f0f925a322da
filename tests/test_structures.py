"""Chunks, batches, graphs, ranges and the folds that have no SQL."""

import random

from pyspark.sql import functions as F

from recallgrid.functions import text as tx
from recallgrid.operators import artifacts, memory, policy, tables
from recallgrid.operators import documents as ds
from recallgrid.plans import registry
from recallgrid.streaming import folds


def test_chunks_cover_and_keep_bounds(spark):
    random.seed(1)
    texts = ["\n\n".join(" ".join(random.choice(["alpha", "be", "gamma"]) for _ in range(random.randint(1, 900))) for _ in range(random.randint(1, 6))) for _ in range(12)]
    texts += ["", "x" * 9000, "one\n\n\n\ntwo", "\n".join("línea " * 30 for _ in range(60))]
    docs = spark.createDataFrame([(i, t, False) for i, t in enumerate(texts)] + [(90, None, False), (91, None, True)], "doc_id int, text string, code boolean")
    got = ds.chunks(docs).collect()
    assert all(r["tokens"] <= 650 for r in got)
    for i, text in enumerate(texts):
        own = sorted((r["ordinal"], r["text"]) for r in got if r["doc_id"] == i)
        assert [o for o, _ in own] == list(range(len(own)))
        assert set(text.split()) <= set(" ".join(t for _, t in own).split()) or len(max(text.split(), key=len)) > 1300
        assert bool(own) == bool(text.strip())


def test_chunks_follow_headings_symbols_and_overlap(spark):
    prose = "# Top\n\nintro words\n\n## Part\n\n" + "\n\n".join(f"p{i} " + "word " * 49 for i in range(30)) + "\n\n# Next\n\nlast"
    code = "import x\n" + "\n".join(f"def f{i}():\n    " + "call() " * 20 for i in range(12))
    docs = spark.createDataFrame([(1, prose, False), (2, code, True)], "doc_id int, text string, code boolean")
    rows = {i: sorted((r for r in ds.chunks(docs).collect() if r["doc_id"] == i), key=lambda r: r["ordinal"]) for i in (1, 2)}
    for r in rows[1] + rows[2]:
        assert r["tokens"] == ds.tokens_of(r["text"]) <= (650 if r["doc_id"] == 1 else 550)
        assert r["key"].rsplit(":", 1)[1] == __import__("hashlib").sha256(r["text"].encode()).hexdigest()[:12]
    assert rows[1][0]["path"] == ["Top"] and rows[1][1]["path"] == ["Top", "Part"] and rows[1][0]["key"].startswith("Top:")
    assert rows[2][0]["key"].startswith("f0:") and rows[2][0]["text"].startswith("def f0")
    for a, b in zip(rows[1], rows[1][1:]):
        again = b["text"].split("\n\n")[0]
        assert again in a["text"] and ds.tokens_of(again) <= 60 and a["tokens"] >= 420
    assert ds.hard_split("x" * 9 + " é" * 3, 2) == ["x" * 8, "x é", " é é"] or ds.hard_split("x" * 9 + " é" * 3, 2)[0] == "x" * 8
    for text, most in (("abc " * 50 + "é" * 20, 7), ("x" * 1000, 9), ("a\n\nb" * 40, 5)):
        pieces = ds.hard_split(text, most)
        assert "".join(pieces) == text and all(ds.tokens_of(x) <= most for x in pieces)
        assert all(ds.tokens_of(a + b[:5]) > most for a, b in zip(pieces, pieces[1:]))


def test_components_cycles_and_chains(spark):
    edges = [(1, 2), (2, 3), (3, 4), (10, 11), (12, 11), (20, 21)]
    got = dict(memory.connected(spark.createDataFrame(edges, "a int, b int")).collect())
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 10: 10, 11: 10, 12: 10, 20: 20, 21: 20}
    deps = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 5), (6, 1)], "task int, needs int")
    assert sorted(map(tuple, memory.cyclic(deps).collect())) == [(1, 2), (2, 3), (3, 1), (6, 1)]
    long = spark.createDataFrame([(i, i + 1) for i in range(600)] + [(1000 + i, 1000 + (i + 1) % 300) for i in range(300)] + [(2000, 1000), (2001, 5)], "task int, needs int")
    assert sorted(r["task"] for r in memory.cyclic(long).collect()) == [*range(1000, 1300), 2000]
    chain = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (7, 8), (8, 7)], "node int, next int")
    seeds = spark.createDataFrame([(1,), (3,), (7,), (9,)], "node int")
    assert sorted(map(tuple, memory.follow(chain, seeds, 3).collect())) == [(1, 1, 0), (1, 2, 1), (1, 3, 2), (3, 3, 0), (3, 4, 1), (7, 7, 0), (7, 8, 1), (9, 9, 0)]


def test_byte_ranges_cut_to_characters(spark):
    text = "aé漢😀" * 40
    docs = spark.createDataFrame([(text,)], "text string")
    chunks = artifacts.chunked(docs, 16)
    assert artifacts.audited(chunks).first()["intact"]
    asked = chunks.select("artifact_id").distinct().select("artifact_id", F.explode(F.sequence(F.lit(0), F.lit(60))).alias("start"), F.lit(50).alias("length"))
    for r in artifacts.read_ranges(asked, chunks, 16).collect():
        part = text.encode()[r["start"] : r["start"] + 50]
        while part and part[0] & 0xC0 == 0x80:
            part = part[1:]
        while True:
            try:
                part.decode()
                break
            except UnicodeDecodeError:
                part = part[:-1]
        assert r["text"] == part.decode(), r["start"]


def test_text_primitives(spark):
    row = spark.createDataFrame([("ﬁne  Text\r\n",)], "t string").select(tx.collapsed(tx.nfkc(F.col("t"))).alias("n"), tx.bigrams(F.col("t")).alias("b"), tx.stable_hash("d", F.lit("é")).alias("h")).first()
    assert row["n"] == "fine Text"
    assert row["b"][:2] == ["ﬁn", "ne"]
    import hashlib

    assert row["h"] == hashlib.sha256("1:d2:é".encode()).hexdigest()


def test_replay_matches_a_plain_loop(spark):
    features = [(i, 1.0 - i / 10, 50, 40, [str(i % 2)]) for i in range(6)]
    cases = spark.createDataFrame([(1, features)], "case_id int, features array<struct<id:bigint,score:double,tokens:int,authority:int,terms:array<string>>>")
    policies = spark.createDataFrame([(0, 30, 9, 4, 1.0, 120), (1, 50, 9, 4, 1.0, 120), (2, 30, 1, 4, 1.0, 120)], policy.POLICY)
    got = {r["policy_id"]: list(r["selected"]) for r in policy.replay(cases, policies).collect()}
    assert got == {0: [0, 1], 1: [], 2: [0]}
    assert policy.accepted({0: (0.5, 0.5, 0), 1: (0.9, 0.5, 0.1), 2: (0.8, 0.4, 0), 3: (0.7, 0.5, 0), 4: (0.7, 0.6, 0)}) == 3
    assert policy.accepted({0: (0.5, 0.5, 0.1), 1: (0.9, 0.5, 0)}) is None


def test_checks_close_the_loops_that_they_resolve():
    event = lambda number, kind, failed=False, text="", **more: {"event_id": number, "kind": kind, "failed": failed, "text": text, "task": None, "call": None, "target": None} | more
    state = folds.empty_state()
    for e in (event(1, "tool_result", True, "npm failed: x", call=7), event(2, "tool_result", True, "lint failed"), event(3, "verification", True, "make test"), event(4, "tool_result", True, "cargo failed")):
        state = folds.reduce_event(state, e)
    assert [x["id"] for x in state["loops"]] == [1, 2, 3, 4]
    state = folds.reduce_event(state, event(5, "verification", False, "unrelated words", call=7))
    state = folds.reduce_event(state, event(6, "verification", False, "other", target=2))
    state = folds.reduce_event(state, event(7, "verification", False, "make test"))
    assert [x["id"] for x in state["loops"]] == [4] and state["confirmed"] == [5, 6, 7]
    state = folds.reduce_event(state, event(8, "goal", text="always use tabs", task=1))
    state = folds.reduce_event(state, event(9, "goal", text="continue", task=1))
    assert (state["goal"], state["decisions"], state["task"]) == (8, [8], 1)
    state = folds.reduce_event(state, event(10, "goal", text="new", task=2))
    assert state["loops"] == state["decisions"] == state["confirmed"] == state["outcomes"] == []


def test_upsert_batches_reject_stale_revisions(spark, tmp_path):
    write = folds.upsert_batch(str(tmp_path), "key", "revision", "value")
    write(spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 5, "c")], "key int, revision int, value string"), 0)
    write(spark.createDataFrame([(1, 1, "old"), (2, 6, "d")], "key int, revision int, value string"), 1)
    write(spark.createDataFrame([(3, 1, "e"), (2, 6, "again")], "key int, revision int, value string"), 2)
    write(spark.createDataFrame([(3, 1, "e"), (2, 6, "again")], "key int, revision int, value string"), 2)
    got = {r["key"]: (r["revision"], r["value"]) for r in folds.read_upserts(spark, str(tmp_path)).collect()}
    assert got[1] == (2, "b") and got[3] == (1, "e") and got[2][0] == 6


def test_repeated_queries_read_the_whole_turn(spark, tmp_path):
    searches = [f"{x} alpha{x} beta{x}" for x in ("first", "second", "third")] + ["first alphafirst betafirst"] * 30 + ["other words here", "too late now"]
    spark.createDataFrame([(1, 0, "user", ".".join(searches))], "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    flags = [r["flag"] for r in sorted(registry.queries()["r32_repeated_queries"](spark, str(tmp_path)).collect(), key=lambda r: r["n"])]
    assert flags == ["recorded"] * 3 + ["repeated"] * 30 + ["recorded", "limit"]


def test_json_leaves_of_any_depth(spark):
    from recallgrid.sources.nested import json_leaves

    deep = '{"a":[{"b":[[1,"x"],{}]},null,true],"c d":2.5}'
    rows = spark.createDataFrame([(1, deep), (2, "7"), (3, "no json"), (4, None), (5, "[]")], "id int, js string")
    got = sorted((r["id"], r["path"], r["value"]) for r in json_leaves(rows, "js", "id").collect())
    assert got == [(1, "a[0].b[0][0]", "1"), (1, "a[0].b[0][1]", "x"), (1, "a[1]", "null"), (1, "a[2]", "true"), (1, "c d", "2.5"), (2, "", "7")]


def test_nfkc_and_folding_reach_beyond_ascii(spark):
    import unicodedata

    texts = ["ﬁne Ⅷ x²\r\n\tend ", "é e\u0301 ñ", "ｆｕｌｌ　width", None, "plain"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", tx.nfkc(F.col("t")).alias("n"), tx.folded(F.col("t")).alias("f")).collect()
    assert {r["i"]: r["n"] for r in rows} == {i: t and unicodedata.normalize("NFKC", t) for i, t in enumerate(texts)}
    assert {r["i"]: r["f"] for r in rows}[1].startswith("e e")
