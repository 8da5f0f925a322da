"""Cycles and components against plain searches, and how rounds grow."""

import random

from recallgrid.operators import memory


def behind_cycles(edges):
    needs = {}
    for a, b in edges:
        needs.setdefault(a, set()).add(b)
    reach = {n: set(x) for n, x in needs.items()}
    grown = True
    while grown:
        grown = False
        for x in reach.values():
            more = set().union(*(needs.get(m, set()) for m in x)) - x
            grown |= bool(more)
            x |= more
    looped = {n for n, x in reach.items() if n in x}
    return {(a, b) for a, b in edges if b in looped or reach.get(b, set()) & looped}


def test_cyclic_equals_plain_reachability(spark):
    random.seed(12)
    edges = set()
    for graph in range(12):  # side by side, from sparse to dense
        n = random.randint(2, 25)
        for _ in range(random.randint(1, int(n * (0.7 + graph * 0.25)))):
            edges.add((100 * graph + random.randrange(n), 100 * graph + random.randrange(n)))
    expected = behind_cycles(edges)
    rows = [*edges, *list(edges)[:9], (None, 1), (1, None)]
    assert {tuple(r) for r in memory.cyclic(spark.createDataFrame(rows, "task int, needs int")).collect()} == expected
    assert 0 < len(expected) < len(edges)
    assert memory.cyclic(spark.createDataFrame([], "task int, needs int")).count() == 0


def ladder(n):
    return [(i, i + k) for i in range(n) for k in (1, 2) if i + k < n]


def test_rounds_follow_the_logarithm_of_a_ladder(spark):
    rounds = []
    for n in (60, 480):
        left, gone = memory.eliminated(spark.createDataFrame(ladder(n), "a int, b int"))
        assert left.isEmpty()
        rounds.append(len(gone))
    assert rounds[0] < 20 and rounds[1] - rounds[0] < 12, rounds


def test_a_cycle_behind_a_long_ladder_is_found(spark):
    edges = [*ladder(100), (99, 200), (200, 201), (201, 200), (300, 301)]
    got = {tuple(r) for r in memory.cyclic(spark.createDataFrame(edges, "task int, needs int")).collect()}
    assert got == set(edges) - {(300, 301)}


def test_components_of_a_long_chain(spark):
    order = list(range(400))
    random.Random(4).shuffle(order)
    edges = [*zip(order, order[1:]), (1000, 1001), (1001, 1000), (1002, 1002), (5, 5), (None, 3)]
    got = dict(memory.connected(spark.createDataFrame(edges, "a int, b int")).collect())
    assert got == {**dict.fromkeys(order, 0), 1000: 1000, 1001: 1000}
