"""Greedy batches and quantiles against plain loops, with keys that reach over many tasks."""

import random

import pytest

from recallgrid.operators import batches


def by_rule(items, most_items, most_tokens):
    out, now = {}, None
    for key, order, size in sorted(items):
        if key != now:
            now, batch, n, spent = key, -1, most_items, 0
        if n >= most_items or spent + size > most_tokens:
            batch, n, spent = batch + 1, 0, 0
        n, spent = n + 1, spent + size
        out[key, order] = batch
    return out


@pytest.mark.parametrize(("tasks", "most_items", "most_tokens"), [(1, 32, 20_000), (13, 32, 20_000), (13, 4, 50), (40, 40, 300_000)])
def test_next_fit_equals_a_plain_loop(spark, monkeypatch, tasks, most_items, most_tokens):
    random.seed(tasks)
    items = [(random.choice(["a", "a", "a", "b", "c"]), i, random.choice([0, 1, 30, random.randint(1, 25_000)])) for i in range(900)] + [("d", 1, 7)]
    spark.conf.set("spark.sql.shuffle.partitions", tasks)
    try:
        rows = batches.next_fit(spark.createDataFrame(items, "source string, doc_id int, tokens int"), "doc_id", "tokens", most_items=most_items, most_tokens=most_tokens, by="source").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert len(rows) == len(items)
    assert {(r["source"], r["doc_id"]): r["batch"] for r in rows} == by_rule(items, most_items, most_tokens)


def test_quantile_is_exact(spark):
    random.seed(1)
    draw = [lambda: random.gauss(0, 1), lambda: 10.0 ** random.randint(-300, 300), lambda: float(random.randint(0, 3)), lambda: 5.0]
    rows = [(k, d()) for k, d in enumerate(draw) for _ in range(random.randint(1, 400))] + [(0, None), (1, float("nan")), (9, None)]
    values = {}
    for k, v in rows:
        if v is not None and v == v:
            values.setdefault(k, []).append(v)
    for share, top in (("0.95", 95), ("0.5", 50), ("1", 100), ("0", 0)):
        expected = {k: sorted(v)[max(-(-top * len(v) // 100), 1) - 1] for k, v in values.items()}
        got = batches.quantile(spark.createDataFrame(rows, "k int, v double"), "k", "v", share, parts=16)
        assert {r["k"]: r["v"] for r in got.collect()} == expected
