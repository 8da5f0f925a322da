"""Inverted lists: recall against exact search, and how many rows are compared and scored."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from recallgrid.operators import approximate as ap
from recallgrid.operators import tables
from recallgrid.plans import registry

SMALL, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.1"


def found(df):
    return {(r["query_id"], r["doc_id"]) for r in df.collect()}


@pytest.mark.parametrize("folder", [SMALL, LARGER])
def test_registered_lane_reaches_its_recall(spark, folder):
    e = spark.read.parquet(f"{folder}/embeddings.parquet").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("v"))
    q = e.where("doc_id % 50 = 0").withColumnRenamed("doc_id", "query_id")
    exact = found(tables.top_cosine(q, e, 10))
    assert len(exact & found(registry.queries()["v2_approximate_top_k"](spark, folder))) >= 0.9 * len(exact)


def test_few_rows_of_clustered_vectors_are_compared_and_scored(spark):
    """Vectors about 60 centres, and a third of all rows one vector: 0.9 of the neighbours from under a fifth of the rows."""
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((60, 32))
    rows = [(i, (centres[i % 60] + 0.4 * rng.standard_normal(32)).astype(float).tolist()) for i in range(2400)]
    rows += [(10_000 + i, rows[0][1]) for i in range(1200)] + [(20_000, None), (20_001, [0.0] * 32), (20_002, [float("nan")] * 32)]
    e = spark.createDataFrame(rows, "doc_id long, v array<double>").repartition(4)
    q = e.where("doc_id % 60 <> 0 AND doc_id % 7 = 0 AND doc_id < 10000").withColumnRenamed("doc_id", "query_id")
    index = ap.build(e, lists=60)
    probed = ap.probed(index, q, 4).join(index.lists, ["list", "part"]).count()
    scored = ap.by_code(index, q, probes=4, refine=60).count()
    exact, asked = found(tables.top_cosine(q, e, 10)), q.count()
    assert len(exact & found(ap.approximate_top(index, q, e, 10, probes=4, refine=60))) >= 0.9 * len(exact)
    assert probed < 0.2 * asked * 3600 and scored <= 60 * asked
    assert index.lists.count() == 3600


def test_hot_lists_are_cut_and_empty_tables_give_nothing(spark, monkeypatch):
    monkeypatch.setattr(ap, "PART", 100)
    e = spark.createDataFrame([(i, [1.0, 0.0] if i < 900 else [0.0, 1.0]) for i in range(1000)], "doc_id long, v array<double>")
    q = e.where("doc_id IN (0, 950)").withColumnRenamed("doc_id", "query_id")
    index = ap.build(e, lists=2)
    assert index.parts.agg(F.max("parts")).first()[0] == 9
    top = ap.approximate_top(index, q, e, 3, probes=2, refine=950).collect()
    assert sorted((r["query_id"], r["rank"], r["doc_id"]) for r in top) == [(0, 1, 0), (0, 2, 1), (0, 3, 2), (950, 1, 900), (950, 2, 901), (950, 3, 902)]
    assert ap.approximate_top(ap.build(e.limit(0)), q, e, 3, probes=2, refine=5).count() == 0
    assert ap.approximate_top(index, q.limit(0), e, 3, probes=2, refine=5).count() == 0
