"""Queries over odd or skewed tables of their own, held to their SQL."""

import math

import duckdb
import numpy as np
from pyspark.sql import Row

from recallgrid.operators import memory, tables
from recallgrid.plans import registry
from recallgrid.streaming import stateful


def rounded(rows):
    return sorted((tuple(round(float(x), 6) if isinstance(x, float) or hasattr(x, "as_tuple") else x for x in r) for r in rows), key=repr)


def held(spark, folder, name, **given):
    """The rows of a query over DataFrames, and those of its SQL."""
    con = duckdb.connect()
    for t, df in given.items():
        df.write.parquet(f"{folder}/{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    result = con.execute(registry.oracle_sql()[name])
    columns = [d[0] for d in result.description]
    return rounded(tuple(r[c] for c in columns) for r in registry.queries()[name](spark, str(folder)).collect()), rounded(result.fetchall())


def test_token_estimates_of_odd_texts(spark, tmp_path):
    texts = ["", None, "...", "日本", "é à", " \t\n", "a\x0bb", "one two　three\u0085four", "a\x1cb\x00c﻿d", "x\r\n\f y", "… — _"]
    documents = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got, expected = held(spark, tmp_path, "p14_token_estimates", documents=documents)
    assert got == expected


def parts(spark, names, copies=40):
    """(p_partkey, p_name, p_brand, p_type, p_size): every name many times, over a few brands, types and sizes."""
    rows = [(3 * i + 7, names[i % len(names)], f"Brand#{i // 7 % 2}", ("SMALL", "LARGE", "ECONOMY")[i // 5 % 3], i * 11 % 31) for i in range(copies * len(names))]
    rows += [(100_000, None, "Brand#1", "LARGE", 6), (100_020, "hot bolt", None, "SMALL", 12), (100_040, "small large", "Brand#0", "LARGE", 30)]
    return spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_type string, p_size int").repartition(3)


NAMES = ["hot bolt", "bolt hot", "red ring", "red config", "small gear", "large config", "blue"]


def largest(df):
    """The most rows that an operator of the executed plan put out, beside scans."""
    found, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        if node.nodeName().startswith("AdaptiveSparkPlan"):
            todo.append(node.executedPlan())
            continue
        if "QueryStage" in node.nodeName():
            todo.append(node.plan())
        rows = node.metrics().get("numOutputRows")
        found = max(found, rows.get().value() if rows.isDefined() else 0)
        todo.extend(node.children().apply(i) for i in range(node.children().size()))
    return found


def small_job(spark, folder, name, most):
    df = registry.queries()[name](spark, str(folder))
    df.collect()
    assert largest(df) <= most


def test_procedures_of_repeated_prompts(spark, tmp_path):
    got, expected = held(spark, tmp_path, "r30_procedure_selection", part=parts(spark, NAMES, 160))
    assert got == expected
    small_job(spark, tmp_path, "r30_procedure_selection", 1_200)


def test_catalogue_of_repeated_texts(spark, tmp_path):
    got, expected = held(spark, tmp_path, "v12_catalogue_matching", part=parts(spark, NAMES[:-1]))
    assert got == expected
    small_job(spark, tmp_path, "v12_catalogue_matching", 1_000)


def test_merge_of_repeated_cues(spark, tmp_path):
    got, expected = held(spark, tmp_path, "l14_familyless_merge", part=parts(spark, NAMES))
    assert got == expected
    small_job(spark, tmp_path, "l14_familyless_merge", 1_000)


def test_cycles_set_aside_what_nothing_needs(spark, monkeypatch):
    edges = [*((100 + i, i % 3) for i in range(60)), (0, 1), (1, 0), (2, 3), (3, 4)]
    met, whole = [], memory.eliminated
    monkeypatch.setattr(memory, "eliminated", lambda e: (met.append(e.count()), whole(e))[1])
    got = memory.cyclic(spark.createDataFrame(edges, "task long, needs long")).collect()
    assert sorted(map(tuple, got)) == sorted(e for e in edges if e[1] < 2)
    assert met == [4]


def test_trigrams_of_odd_texts(spark, tmp_path):
    texts = ["", None, "a", "Éé", "abc", "ABCabc" * 150, "日本語の文" * 90, "x😀😀y z", "😀", "a\x00b\nc", "ÿĀÿĀÿ"]
    rows = [*enumerate(texts), (5, "again abc"), (None, "no id"), (None, "nor here")]
    documents = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    got, expected = held(spark, tmp_path, "i15_trigram_vectors", documents=documents)
    assert got == expected
    small_job(spark, tmp_path, "i15_trigram_vectors", 65 * len(rows))


def test_nearest_in_many_scopes_meet_their_own_block_only(spark):
    rows = [(i, i % 40 if i % 3 else None if i % 30 else 77, [math.sin(i * d + 1) for d in (1, 2, 3)]) for i in range(600)]
    e = spark.createDataFrame(rows, "doc_id long, scope long, v array<double>")
    df = tables.top_cosine(e.where("doc_id % 5 = 0").withColumnRenamed("doc_id", "query_id"), e, 4, within=["scope"], per_block=30)
    got = {(r["query_id"], r["rank"]): r["doc_id"] for r in df.collect()}
    unit = {i: np.array(v) / np.linalg.norm(v) for i, _, v in rows}
    expected = {}
    for i, scope, _ in rows:
        if i % 5 == 0:
            near = sorted((-round(float(unit[i] @ unit[j]), 9), j) for j, other, _ in rows if other == scope)
            expected |= {(i, r): j for r, (_, j) in enumerate(near[:4], 1)}
    assert got == expected
    assert largest(df) <= 2_000  # 120 queries met 20 blocks each before


def test_sessions_pass_the_stream_as_rows():
    class Held:
        value = None

        def get(self):
            return self.value

        def update(self, value):
            self.value = value

    session = stateful.WorkingState()
    session.held = Held()
    event = lambda seq, kind, failed: Row(seq=seq, event_id=10 + seq, kind=kind, failed=failed, text="build it", task=None, call=None, target=None)
    list(session.handleInputRows((1, None), iter([event(2, "tool_result", True), event(1, "goal", False)]), None))
    (row,) = session.handleInputRows((1, None), iter([event(3, "tool_call", False)]), None)
    assert (row["goal"], row["loops"], row["resources"], row["seen"]) == (11, [{"id": 12, "call": None, "text": "resolve build it"}], ["build it"], 3)
