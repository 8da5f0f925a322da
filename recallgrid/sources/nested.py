"""Leaves of nested JSON values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written


def json_leaves(rows: DataFrame, json: str, *keys: str) -> DataFrame:
    """(*keys, path, kind, value): a row for each scalar in the JSON texts, with paths like a.b[0].c and values as text.

    Texts that are no JSON have no leaves; empty objects and arrays have none either. Containers are opened one level a
    round until none is left; each round's leaves are a table in the shared folder.
    """
    spark = rows.sparkSession
    level = rows.select(*keys, F.lit("").alias("path"), F.try_parse_json(json).alias("v")).where("v IS NOT NULL")
    leaves = None
    while True:
        level = written(level.withColumn("kind", F.schema_of_variant("v")), "level")
        container = F.col("kind").startswith("OBJECT") | F.col("kind").startswith("ARRAY")
        own = level.where(~container).select(*keys, "path", "kind", F.coalesce(F.variant_get("v", "$", "string"), F.lit("null")).alias("value"))
        leaves = own if leaves is None else leaves.union(own)
        inner = level.where(container)
        if inner.isEmpty():
            return leaves
        opened = inner.lateralJoin(spark.tvf.variant_explode(F.col("v").outer()))
        step = F.when(F.col("key").isNull(), F.concat(F.lit("["), F.col("pos").cast("string"), F.lit("]"))).when(F.col("path") == "", F.col("key")).otherwise(F.concat(F.lit("."), F.col("key")))
        level = opened.select(*keys, F.concat("path", step).alias("path"), F.col("value").alias("v"))
