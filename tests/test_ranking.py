"""Golden values and rules of fusion, scores, cutoff, marginal relevance and packing."""

from pyspark.sql import functions as F

from recallgrid.operators import ranking as rk


def rows(df, *columns):
    return [tuple(r[c] for c in columns) for r in df.collect()]


def test_fusion_sums_weighted_reciprocal_ranks(spark):
    lanes = spark.createDataFrame([(1, 1, 1.0, 1, "a"), (1, 1, 1.0, 2, "b"), (1, 2, 2.0, 1, "b"), (1, 2, 2.0, 2, "a"), (1, 2, 1.0, 2, "c")], "query_id int, lane int, weight double, rank int, doc_id string")
    got = dict(rows(rk.fuse(lanes, 1), "doc_id", "score"))
    assert {k: round(v, 6) for k, v in got.items()} == {"a": round(1 / 2 + 2 / 3, 6), "b": round(1 / 3 + 1.0, 6), "c": round(1 / 3, 6)}


def test_authority_and_freshness(spark):
    month = 30 * 86_400_000
    df = spark.createDataFrame([(0.8, 80, month), (0.8, 80, 0), (0.8, 80, 2 * month), (0.8, 80, None)], "score double, authority int, updated long")
    got = rows(df.select(F.round(rk.authority_and_freshness(F.col("score"), F.col("authority"), F.col("updated"), month), 6).alias("s")), "s")
    assert got == [(0.82,), (0.77,), (0.82,), (0.82,)]


def test_lexical_floor_and_cutoff(spark):
    assert rows(spark.range(1).select(rk.lexical_floor(F.lit(0.01), F.lit(True)).alias("a"), rk.lexical_floor(F.lit(0.01), F.lit(False)).alias("b")), "a", "b") == [(0.04, 0.01)]
    hits = spark.createDataFrame([(1, d, s) for d, s in enumerate((0.9, 0.85, 0.8, 0.5, 0.49))] + [(2, 0, 0.03)], "query_id int, doc_id int, score double")
    assert sorted(rows(rk.adaptive_cutoff(hits, "doc_id"), "query_id", "doc_id")) == [(1, 0), (1, 1), (1, 2)]


def test_marginal_relevance_prefers_the_different(spark):
    hits = spark.createDataFrame([(1, "a", 1.0, 1, ["x", "y"]), (1, "b", 0.95, 2, ["x", "y"]), (1, "c", 0.8, 3, ["z"])], "query_id int, doc_id string, score double, position int, terms array<string>")
    assert sorted(rows(rk.mmr(hits, 3, 0.5), "mmr_rank", "doc_id")) == [(1, "a"), (2, "c"), (3, "b")]


def test_packing_skips_what_does_not_fit(spark):
    hits = spark.createDataFrame([(1, "big", "knowledge", 0.9, 90, 1), (1, "k", "knowledge", 0.8, 30, 2), (1, "m", "memory", 0.7, 20, 3), (1, "m2", "memory", 0.6, 20, 4)], "query_id int, doc_id string, kind string, density double, cost int, position int")
    got = rk.pack_context(hits, total=60, knowledge=50, memory=25)
    assert sorted(rows(got, "place", "doc_id")) == [(0, "k"), (1, "m")]


def test_dedupe_keeps_the_best(spark):
    hits = spark.createDataFrame([(1, 1, 0.5, "h"), (1, 2, 0.7, "h"), (1, 3, 0.7, "h"), (2, 4, 0.1, "h")], "query_id int, doc_id int, score double, hash string")
    assert sorted(rows(rk.structural_dedupe(hits, "hash", tie="doc_id"), "doc_id")) == [(2,), (4,)]


def test_boundary_gate_truth_table(spark):
    cases = [("knowledge", "t::x", False), ("knowledge", "u::x", False), ("knowledge", "plain", False), ("knowledge", "plain", True), ("memory", "t", False), ("memory", "u", False)]
    df = spark.createDataFrame(cases, "kind string, ns string, local boolean")
    got = [r[0] for r in df.select(rk.boundary_gate(F.col("kind"), F.col("ns"), F.lit("t"), F.col("local"))).collect()]
    assert got == [None, "security:knowledge-scope-mismatch", "security:unscoped-legacy-knowledge", None, None, "security:scope-mismatch"]


def test_empty_tables_give_empty_results(spark):
    hits = spark.createDataFrame([], "query_id int, doc_id int, score double, hash string")
    assert rk.adaptive_cutoff(hits, "doc_id").count() == 0
    assert rk.structural_dedupe(hits, "hash", tie="doc_id").count() == 0
