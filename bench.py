"""Runs the headline queries on $BENCH_SF_DIR and prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from recallgrid.plans import registry

HEADLINE = (
    "retrieval_slice", "v1_dense_top_k", "v3_full_text", "v4_hybrid_fusion", "r11_scores", "r19_cutoff_focused", "r20_mmr",
    "p1_page_text", "p6_links", "p10_markdown_blocks", "p16_chunks", "i3_vector_reuse", "m4_lifecycle", "l16_topics",
    "l9_recovery_mining", "e8_artifact_audit", "e14_task_episodes", "a4_effectiveness", "a9_coordinate_search", "t1_working_state",
)


def main() -> None:
    folder, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    conf = {"spark.ui.enabled": "false", "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "8g", "spark.sql.session.timeZone": "UTC", "spark.ui.showConsoleProgress": "false"}
    spark = SparkSession.builder.master(f"local[{cpus}]").config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    queries, took = registry.queries(), {}
    for name in HEADLINE:
        began = time.perf_counter()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
