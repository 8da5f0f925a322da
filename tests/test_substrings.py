"""Search inside texts: any occurrence, chunks with carry, ranked windows."""

import random

from recallgrid.operators import substrings as ss


def found(spark, queries, docs, **how):
    q = spark.createDataFrame(queries, "query_id int, text string")
    d = spark.createDataFrame(docs, "doc_id int, text string")
    return ss.all_terms(q, d, 8, **how)


def test_terms_count_inside_words(spark):
    docs = [(0, "the cab is cd here"), (1, "our database"), (2, "ab only"), (3, None), (4, ""), (5, "ÀB \n cD")]
    rows = found(spark, [(0, "ab cd"), (1, "data"), (2, "x"), (3, None), (4, " \t"), (5, "àb"), (6, "is s i")], docs).collect()
    assert {(r["query_id"], r["doc_id"]) for r in rows} == {(0, 0), (1, 1), (5, 5), (6, 0)}


def test_all_terms_equals_brute_force(spark):
    random.seed(8)
    letters = ["a", "b", "é", " ", "\n", "Ab", "cd"]
    docs = [(i, "".join(random.choice(letters) for _ in range(random.randint(0, 120)))) for i in range(60)]
    queries = [(i, " ".join("".join(random.choice("abcdé") for _ in range(random.randint(1, 4))) for _ in range(random.randint(1, 3)))) for i in range(40)]
    expected = set()
    for k, query in queries:
        terms = query.lower().split()
        for i, text in docs:
            hits = 0
            for chunk, at in enumerate(range(0, max(1, len(text)), 40)):
                first = max(0, at - 20)
                part = text[first : at + 40]
                low = part.lower()
                if all(t in text.lower() for t in terms) and all(t in low for t in terms) and hits < 8:
                    hits += 1
                    place = min(low.index(t) for t in terms)
                    a, b = max(0, place - 5), min(len(part), place + 9)
                    expected.add((k, i, chunk, len(text[: first + a].encode()), len(text[: first + b].encode())))
    rows = found(spark, queries, docs, size=40, carry=20, before=5, after=9).collect()
    assert {tuple(r)[:5] for r in rows} == expected and len(expected) > 200


def test_candidates_are_far_fewer_than_pairs(spark):
    random.seed(4)
    word = lambda: "".join(random.choice("abcdefghij") for _ in range(5))
    words = [word() for _ in range(3000)]
    docs = [(i, " ".join(random.choice(words) for _ in range(30))) for i in range(400)]
    queries = [(i, " ".join(docs[i * 7][1].split()[:4])) for i in range(50)]
    q = spark.createDataFrame([(i, t.split()) for i, t in queries], "query_id int, needles array<string>")
    met = {tuple(r) for r in ss.candidates(q, spark.createDataFrame(docs, "doc_id int, t string")).collect()}
    true = {(k, i) for k, t in queries for i, d in docs if all(x in d for x in t.split())}
    assert true <= met and len(met) < 0.1 * len(queries) * len(docs)


def ask(spark, query, text, **how):
    rows = ss.anchored(spark.createDataFrame([(0, 1, query, text)], "query_id int, doc_id int, query string, text string"), **how).collect()
    return sorted(rows, key=lambda r: r["n"])


def test_a_detail_of_the_last_chunk_comes_before_common_words(spark):
    common = "RUN_COMMON navigation line\n" * 4000
    marker = "DETAIL_TAIL_7f3a = final recovery value"
    text = common * 3 + marker + "\n"
    rows = ask(spark, "please locate DETAIL_TAIL_7f3a, its value", text, size=len(common))
    assert rows[0]["kind"] == "lexical" and rows[0]["chunk"] == 3
    assert marker in text.encode()[rows[0]["byte_start"] : rows[0]["byte_end"]].decode()


def test_exact_words_dominate_in_several_windows(spark):
    text = "x" * 3000 + "Alpha Beta" + "y" * 3000 + "alpha  beta" + "z" * 3000 + "ALPHA BETA gamma"
    rows = ask(spark, " alpha beta ", text)
    assert [(r["kind"], r["byte_start"]) for r in rows] == [("exact", 3000 - 240), ("exact", text.index("ALPHA") - 240)]
    assert [r["kind"] for r in ask(spark, "data", "our database")] == ["exact"]
    assert ask(spark, "data", None) == [] and ask(spark, None, "data") == [] and ask(spark, " ", "data") == []


def test_a_match_over_two_chunks_is_carried(spark):
    text = "a" * 95 + "needle here" + "b" * 200
    assert ask(spark, "needle here", text, size=100, carry=0) == [] or ask(spark, "needle here", text, size=100, carry=0)[0]["kind"] == "lexical"
    rows = ask(spark, "needle here", text, size=100, carry=50)
    assert len(rows) == 1 and rows[0]["kind"] == "exact" and rows[0]["chunk"] == 1
