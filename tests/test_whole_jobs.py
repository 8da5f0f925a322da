"""Queries over conversations keep what shares little or nothing; odd tables against the same SQL."""

import duckdb
import pytest

from recallgrid.plans import registry

WORDS = "alder birch cedar dogwood elm fir gorse hazel ivy juniper".split()


def held(spark, folder, turns, name, items=((0, "alder birch"),)):
    """The query's rows over (conv_id, turn, role, text), and those of its SQL, sorted."""
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").repartition(3).write.parquet(f"{folder}/conversations.parquet")
    spark.createDataFrame(list(items), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    con = duckdb.connect()
    for t in ("conversations", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    result = con.execute(registry.oracle_sql()[name])
    columns = [d[0] for d in result.description]
    expected = sorted(result.fetchall(), key=repr)
    return sorted((tuple(r[c] for c in columns) for r in registry.queries()[name](spark, str(folder)).collect()), key=repr), expected, columns


def rounded(rows):
    return [tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in rows]


def long_talk():
    """60 turns of one to three words of ten, some without a text or words; a second talk whose turns share nothing; turns beyond 1,000, whose ids recur in the next talk."""
    texts = [None if t % 13 == 5 else "" if t % 17 == 4 else " ".join(WORDS[(t * k) % 10] for k in range(1, 2 + t % 3)) for t in range(60)]
    rows = [(1, t, "user" if t % 4 else "assistant", x) for t, x in enumerate(texts)]
    rows += [(2, t, "user", w) for t, w in enumerate(WORDS[:4])]
    rows += [(5, 1000 + t, "user", f"{WORDS[t]} {WORDS[t + 1]} knot") for t in range(4)] + [(6, t, "user", f"{WORDS[t]} reed") for t in range(4)]
    return [*rows, (2, None, "user", "alder"), (None, 3, "user", "alder")]


AGAIN = [(1, 7, "user", "alder reed"), (1, 7, "user", "alder reed"), (1, 7, "user", "birch knot knob")]


@pytest.mark.parametrize("talk", ["far", "long"])
def test_marginal_relevance_ranks_turns_without_a_shared_term(spark, tmp_path, talk):
    turns = [(1, t, "user", w) for t, w in enumerate(WORDS[:4])] if talk == "far" else long_talk()
    got, expected, columns = held(spark, tmp_path, turns, "r20_mmr")
    assert rounded(got) == rounded(expected)
    if talk == "far":
        assert sorted(dict(zip(columns, r))["doc_id"] for r in got) == [1000, 1001, 1002] and all(dict(zip(columns, r))["score"] == 0 for r in got)


@pytest.mark.parametrize("talk", ["far", "long"])
def test_merge_names_the_nearest_statement_however_far(spark, tmp_path, talk):
    turns = [(1, 0, "user", "alder birch cedar"), (1, 3, "user", "alder elm fir gorse"), (1, 6, "user", "elm fir gorse alder"), (1, 9, "user", "ivy")] if talk == "far" else long_talk() + AGAIN
    got, expected, columns = held(spark, tmp_path, turns, "l4_near_duplicate_merge")
    assert rounded(got) == rounded(expected)
    if talk == "far":
        assert {r["id"]: (r["same_as"], r["overlap"], r["merges"]) for r in (dict(zip(columns, r)) for r in got)} == {1003: (1000, 0.25, False), 1006: (1003, 1.0, True)}


def test_topics_without_a_match_keep_the_nearest_similarity(spark, tmp_path):
    turns = [(1, t, "user", x) for t, x in enumerate(["alder one two three four", "birch one two three four five", "none of these"])]
    items = [(7, "alder birch cedar dogwood elm fir gorse"), (8, "hazel ivy")]
    got, expected, columns = held(spark, tmp_path, turns, "l16_topics", items)
    assert rounded(got) == rounded(expected)
    (row,) = (dict(zip(columns, r)) for r in got)
    assert (row["topic"], row["n"], row["mean"]) == (None, 3, round((1 / 5 + 1 / 6) / 3, 6))


def test_topics_of_odd_tables(spark, tmp_path):
    items = [(0, "alder birch reed"), (0, "knot alder"), (1, "birch alder reed"), (2, None), (None, "hazel"), (3, "fir elm gorse dogwood juniper ivy alder")]
    got, expected, _ = held(spark, tmp_path, long_talk() + AGAIN, "l16_topics", items)
    assert rounded(got) == rounded(expected)
