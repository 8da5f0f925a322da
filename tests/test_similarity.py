"""Joins of term sets by similarity against all pairs, and how few pairs they form."""

import random

import pytest

from recallgrid.operators import similarity as sm


@pytest.fixture(scope="module")
def sets():
    """Terms from very common to rare, near copies, empty and null sets."""
    random.seed(7)
    term = lambda: f"t{min(int(random.paretovariate(0.5)), 5000)}"
    out = [(i, sorted({term() for _ in range(random.randint(1, 30))})) for i in range(300)]
    for i in range(300, 420):
        base = [t for t in random.choice(out[:300])[1] if random.random() < 0.9]
        out.append((i, sorted({*base, term()})))
    return [*out, (900, []), (901, None)]


@pytest.mark.parametrize(("threshold", "of"), [(0.65, "larger"), (0.5, "larger"), (0.25, "smaller"), (1.0, "smaller"), (1.0, "larger")])
def test_similar_equals_all_pairs(spark, sets, threshold, of):
    t = spark.createDataFrame([(i, i % 2, x) for i, x in sets], "id int, scope int, terms array<string>")
    got = {(r["id"], r["other"], r["shared"]) for r in sm.similar(t, t, threshold, of=of, within=["scope"], only="other < id").collect()}
    pairs = [(i, j, set(x), set(y)) for i, x in sets for j, y in sets if j < i and i % 2 == j % 2 and x and y]
    size = max if of == "larger" else min
    expected = {(i, j, len(x & y)) for i, j, x, y in pairs if len(x & y) >= threshold * size(len(x), len(y)) - 1e-9}
    assert got == expected and got


@pytest.mark.parametrize(("threshold", "of", "share"), [(0.65, "larger", 0.1), (0.5, "smaller", 0.65)])
def test_far_fewer_pairs_meet_than_share_a_term(spark, sets, threshold, of, share):
    sets = [s for s in sets if s[1] and len(s[1]) > 8]
    t = spark.createDataFrame(sets, "id int, terms array<string>")
    met = sm.candidates(t, t, threshold, of=of).count()
    assert met < share * sum(bool(set(x) & set(y)) for _, x in sets for _, y in sets)


def test_strongest_loses_none_and_looks_few_up(spark, sets):
    """The k best distinct contents by shared terms, ties too; far fewer pairs are counted than share a term."""
    rows = [(i, 0, i, x, f"c{i % 90}") for i, x in sets if x and len(x) > 8]
    d = spark.createDataFrame(rows, "id int, scope int, at int, terms array<string>, content string")
    q = d.where("id % 5 = 0").withColumnRenamed("id", "query_id").drop("content")
    got = {(r["query_id"], r["id"]): r["shared"] for r in sm.strongest(q, d, 4, of="content", within=["scope"], only="when < at").collect()}
    pairs = 0
    for i, scope, _, x, _ in rows:
        if i % 5 == 0:
            shared = {j: (len(set(x) & set(y)), c) for j, s, _, y, c in rows if s == scope and j < i and set(x) & set(y)}
            pairs += len(shared)
            best = {}
            for n, c in shared.values():
                best[c] = max(best.get(c, 0), n)
            bound = sorted(best.values(), reverse=True)[3] if len(best) > 3 else 1
            assert {j: n for j, (n, _) in shared.items() if n >= bound}.items() <= {j: n for (k, j), n in got.items() if k == i}.items()
    assert len(got) < 0.6 * pairs, (len(got), pairs)
    assert sm.meeting(q, d, ["scope"], "when < at").count() == pairs
