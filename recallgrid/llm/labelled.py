"""Bounded samples of labelled and unlabelled rows, for the classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import stored


def remainder(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text (null: empty) mod ``parts``."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts


def sample_labels(labels: DataFrame, column: str, parts: int, held: int, most: int) -> DataFrame:
    """(doc_id, label): at most ``most`` rows that may be learnt from, the first by a hash of the id; one row an id.

    Null ids and null labels teach nothing; of contradicting labels of one id the larger stands.
    """
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("int").alias("label")).dropna()
    rows = rows.where(remainder(F.col("doc_id"), parts) != held).groupBy("doc_id").agg(F.max("label").alias("label"))
    return rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def sample_ids(docs: DataFrame, id_column: str, parts: int, held: int, most: int) -> DataFrame:
    """(doc_id, label null): at most ``most`` ids of documents outside the held-out fold, the first by a hash of the id."""
    ids = docs.select(F.col(id_column).cast("long").alias("doc_id")).dropna()
    ids = ids.where(remainder(F.col("doc_id"), parts) != held).distinct()
    return ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).withColumn("label", F.lit(None).cast("int"))


def scored_schema(docs: DataFrame) -> T.StructType:
    return T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])


def one_text_an_id(docs: DataFrame, chosen: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(doc_id, text, label) of the ids in ``chosen`` (doc_id, label), stored once; of repeated ids the text with the least hash."""
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    joined = rows.join(F.broadcast(chosen), "doc_id")  # a bounded sample of ids
    one = joined.groupBy("doc_id", "label").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("t"))
    return stored(one.select("doc_id", F.col("t.text").alias("text"), "label"), "sample")
