"""Derived tables that queries and their SQL share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


RECORDS = """records AS (SELECT conv_id * 1000 + turn AS id, conv_id AS ns, turn, role, text AS content,
  CASE role WHEN 'user' THEN 100 WHEN 'assistant' THEN 10 ELSE 90 END AS authority, turn * 86400000 AS ts FROM conversations)"""


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as memory records: the conversation is the namespace, the role gives the authority."""
    t = table(spark, sf_dir, "conversations")
    authority = F.when(F.col("role") == "user", 100).when(F.col("role") == "assistant", 10).otherwise(90)
    return t.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("conv_id").alias("ns"), "turn", "role", F.col("text").alias("content"), authority.alias("authority"), (F.col("turn") * 86400000).alias("ts"))


EDGES = """edges AS (SELECT id AS from_id, lag(id) OVER (PARTITION BY ns ORDER BY turn) AS to_id, ns, ts,
  CASE turn % 5 WHEN 0 THEN 'supersede' WHEN 1 THEN 'retract' WHEN 2 THEN 'conflict' WHEN 3 THEN 'coexist' ELSE 'reinforce' END AS relation
  FROM records WHERE role = 'user' QUALIFY to_id IS NOT NULL)"""


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From each user turn to the user turn before it, with a relation by the turn number."""
    kinds = ("supersede", "retract", "conflict", "coexist", "reinforce")
    relation = F.element_at(F.array(*map(F.lit, kinds)), (F.col("turn") % 5 + 1).cast("int"))
    users = records(spark, sf_dir).where("role = 'user'")
    before = F.lag("id").over(Window.partitionBy("ns").orderBy("turn"))
    return users.select(F.col("id").alias("from_id"), before.alias("to_id"), "ns", "ts", relation.alias("relation")).where("to_id IS NOT NULL")


EPISODES = """episode_events AS (SELECT event_id, user_id, CAST(ts AS DATE) AS day, ts, value, event_type,
  row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) AS seq,
  CASE event_type WHEN 'signup' THEN 'goal' WHEN 'view' THEN 'tool_call' WHEN 'click' THEN 'tool_result' WHEN 'error' THEN 'tool_result' ELSE 'verification' END AS kind,
  event_type = 'error' AS failed FROM events)"""


def episode_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as episodes by user and day, numbered by time."""
    e = table(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    kind = F.when(F.col("event_type") == "signup", "goal").when(F.col("event_type") == "view", "tool_call").when(F.col("event_type").isin("click", "error"), "tool_result").otherwise("verification")
    seq = F.row_number().over(Window.partitionBy("user_id", "day").orderBy("ts", "event_id"))
    return e.select("event_id", "user_id", "day", "ts", "value", "event_type", seq.alias("seq"), kind.alias("kind"), (F.col("event_type") == "error").alias("failed"))


DOCS_V = """docs_v1 AS (SELECT doc_id, text, source, sha256(text) AS fingerprint FROM documents WHERE doc_id % 10 <> 0),
docs_v2 AS (SELECT doc_id, source, CASE WHEN doc_id % 7 = 0 THEN text || ' v2' ELSE text END AS text,
  sha256(CASE WHEN doc_id % 7 = 0 THEN text || ' v2' ELSE text END) AS fingerprint FROM documents WHERE doc_id % 10 <> 1)"""


def snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two states of the documents: some deleted, some new, some changed."""
    d = table(spark, sf_dir, "documents")
    later = F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit(" v2"))).otherwise(F.col("text"))
    one = d.where("doc_id % 10 <> 0").select("doc_id", "text", "source")
    two = d.where("doc_id % 10 <> 1").select("doc_id", later.alias("text"), "source")
    return tuple(x.withColumn("fingerprint", F.sha2("text", 256)) for x in (one, two))
