"""Artifacts: content-addressed chunks, audits and byte ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def chunked(docs: DataFrame, size: int) -> DataFrame:
    """(artifact_id, ordinal, byte_offset, bytes, chunk_hash) of the distinct texts as bytes; the id is the whole's hash."""
    data = F.col("text").cast("binary")
    whole = docs.select(F.sha2(data, 256).alias("artifact_id"), data.alias("data")).dropDuplicates(["artifact_id"])
    starts = F.sequence(F.lit(0), F.greatest(F.octet_length("data") - 1, F.lit(0)), F.lit(size))
    parts = whole.select("artifact_id", "data", F.posexplode(starts).alias("ordinal", "byte_offset"))
    piece = F.expr(f"substring(data, byte_offset + 1, {size})")
    return parts.select("artifact_id", "ordinal", "byte_offset", piece.alias("bytes")).withColumn("chunk_hash", F.sha2("bytes", 256))


def audited(chunks: DataFrame) -> DataFrame:
    """(artifact_id, chunks, intact): ordinals and offsets go on without a gap and every hash is right."""
    w = Window.partitionBy("artifact_id").orderBy("ordinal")
    before = F.lag(F.struct(F.col("byte_offset"), F.octet_length("bytes").alias("n"))).over(w)
    c = chunks.withColumn("before", before)
    ok = (F.col("chunk_hash") == F.sha2("bytes", 256)) & F.coalesce(F.col("byte_offset") == F.col("before.byte_offset") + F.col("before.n"), F.col("byte_offset") == 0)
    return c.groupBy("artifact_id").agg(F.count("*").alias("chunks"), (F.bool_and(ok) & (F.max("ordinal") == F.count("*") - 1)).alias("intact"))


def read_ranges(requests: DataFrame, chunks: DataFrame, size: int) -> DataFrame:
    """requests (artifact_id, start, length) with ``text``: the bytes of the range, cut to whole characters at both ends."""
    touched = F.sequence(F.floor(F.col("start") / size).cast("int"), F.floor((F.col("start") + F.greatest(F.col("length"), F.lit(1)) - 1) / size).cast("int"))
    r = requests.withColumn("ordinal", F.explode(touched)).join(chunks.select("artifact_id", "ordinal", "byte_offset", "bytes"), ["artifact_id", "ordinal"])
    lo = F.greatest(F.col("start") - F.col("byte_offset"), F.lit(0))
    hi = F.least(F.col("start") + F.col("length") - F.col("byte_offset"), F.octet_length("bytes"))
    r = r.withColumn("lo", lo.cast("int")).withColumn("n", (hi - lo).cast("int")).where("n > 0").withColumn("part", F.expr("hex(substring(bytes, lo + 1, n))"))
    whole = r.groupBy("artifact_id", "start", "length").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "part"))), lambda x: x["part"]), "").alias("h"))
    head = F.regexp_replace("h", "^((8|9|A|B)[0-9A-F])+", "")
    tail = F.regexp_replace(head, "((C|D)[0-9A-F]|E[0-9A-F](([89AB][0-9A-F])?)|F[0-9A-F](([89AB][0-9A-F]){0,2}))$", "")
    aligned = F.when(F.length(tail) % 2 == 0, tail).otherwise(head)
    return whole.select("artifact_id", "start", "length", F.unhex(aligned).cast("string").alias("text"))


def expired(captures: DataFrame, now: int) -> DataFrame:
    """(artifact_id, captures, expires, state) of captures (artifact_id, expires): what is captured again lives until its last capture
    ends, for ever if one has no end; what has ended at ``now`` is expired."""
    last = F.when(F.count("*") == F.count("expires"), F.max("expires")).alias("expires")
    artifacts = captures.groupBy("artifact_id").agg(F.count("*").alias("captures"), last)
    return artifacts.withColumn("state", F.when(F.col("expires") <= now, "expired").otherwise("ready"))


#: Shell commands whose result verifies something; a fixed value.
VERIFICATION = r"(?:^|\s)(?:test|typecheck|lint|check|build|verify|go\s+test|cargo\s+test|pytest|vitest|jest|tsc)(?:\s|$)"


def verifications(calls: DataFrame, results: DataFrame, *keys: str) -> DataFrame:
    """calls (*keys, tool, command) of shell commands that verify something, with the ``status`` that their result (*keys, is_error) gives;
    a call without a result verifies nothing."""
    asked = calls.where((F.col("tool") == "bash") & F.col("command").rlike("(?i)" + VERIFICATION))
    return asked.join(results, list(keys)).withColumn("status", F.when(F.col("is_error"), "failed").otherwise("passed")).drop("is_error", "tool")
