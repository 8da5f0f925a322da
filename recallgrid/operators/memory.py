"""Memory assertions: reinforcement, idempotent commands, lifecycle, relationship gates, views; task graphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import checkpointed, written


def reinforced(records: DataFrame) -> DataFrame:
    """One row for each namespace and content: the first id, how often it was said again, and the most it was worth."""
    return records.groupBy("ns", F.sha2("content", 256).alias("content_hash")).agg(F.min("id").alias("id"), (F.count("*") - 1).alias("reinforcements"), F.max("authority").alias("authority"), F.max("ts").alias("last_seen"), F.array_sort(F.collect_set("role")).alias("evidence"))


def idempotent(commands: DataFrame, key: str, order: str, command_hash: str) -> DataFrame:
    """The first command of each key, and whether a later one under the same key asked for something else."""
    first = commands.groupBy(key).agg(F.min(F.struct(order, command_hash)).alias("first"), (F.min(command_hash) != F.max(command_hash)).alias("conflict"))
    return first.select(key, F.col(f"first.{order}").alias(order), "conflict")


def lifecycle(records: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, status): what the latest destructive edge onto a record makes of it; other edges leave it as it is."""
    status = F.when(F.col("relation") == "supersede", "superseded").when(F.col("relation") == "retract", "tombstoned")
    latest = edges.withColumn("status", status).where("status IS NOT NULL").groupBy(F.col("to_id").alias("id")).agg(F.max_by("status", F.struct("ts", "from_id")).alias("status"))
    return records.select("id", "ns").join(latest, "id", "left").select("id", "ns", F.coalesce("status", F.lit("active")).alias("status"))


def temporal_state(status: Column) -> Column:
    return F.when(status == "active", "current").when(status == "superseded", "historical").when(status == "conflicted", "conflicted").otherwise("invalid")


def first_and_lead(proposals: DataFrame, key: str, score: str, tie: str, margin: float) -> DataFrame:
    """Of each key's proposals the strongest, and whether the next is so near that the choice is ambiguous."""
    w = Window.partitionBy(key).orderBy(F.desc(score), tie)
    ranked = proposals.withColumn("r", F.row_number().over(w)).withColumn("next", F.lead(score).over(w)).where("r = 1")
    return ranked.withColumn("ambiguous", F.coalesce(F.col(score) - F.col("next") < margin, F.lit(False))).drop("r", "next")


def connected(edges: DataFrame) -> DataFrame:
    """(node, root) of an undirected edge table (a, b): the least node that links reach; loops and nulls are dropped. Every round
    hangs each node's larger neighbours, then all its smaller ones, under its least one, so edges don't grow in number and rounds
    follow the logarithm of a component's size; it ends when nothing moves."""
    high, low = F.greatest("a", "b"), F.least("a", "b")
    now, before = written(edges.where("a <> b").select(high.alias("u"), low.alias("v")).distinct(), "links"), None
    while (state := tuple(now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())) != before and state[0]:
        both = now.union(now.select("v", "u")).toDF("u", "v")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("low"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("low").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("low"))
        small = large.join(least, "u").where("v <> low").select(F.col("v").alias("u"), F.col("low").alias("v")).union(least)
        now, before = written(small.distinct(), "links"), state
    return now.union(now.select("v", "v").distinct()).toDF("node", "root")


def eliminated(edges: DataFrame, *, fill: int = 8, seed: int = 3) -> tuple[DataFrame, list[DataFrame]]:
    """What is left of the edges (a, b) when tasks are taken out one independent set a round, and the needs of each set's tasks.

    A task taken out hands its needs to those that need it, so cycles stay as they are. Tasks are taken while that adds no
    more than ``fill`` edges: ends and chains of all kinds, and whatever has few edges, so a long graph shrinks by a share of
    its tasks each round. Among neighbours those without needs go first, then the least hash. A task that needs itself
    keeps one edge to null, which stands for a cycle. What is left has no end: all of it leads into a cycle.
    """
    left, gone = written(edges.select("a", "b").distinct(), "needs"), []
    while True:
        left = left.select("a", F.nullif("b", "a").alias("b"))
        closed = left.where("b IS NULL").select("a").distinct()
        left = left.join(closed, "a", "left_anti").unionByName(closed.withColumn("b", F.lit(None).cast(left.schema["b"].dataType)))
        outs = left.groupBy(F.col("a").alias("v")).agg(F.count("*").alias("outs"))
        ins = left.where("b IS NOT NULL").groupBy(F.col("b").alias("v")).agg(F.count("*").alias("ins"))
        nodes = outs.join(ins, "v", "full_outer").fillna(0)
        rank = F.struct((F.col("outs") > 0).alias("goes_on"), F.xxhash64("v", F.lit(seed + len(gone))).alias("h"), "v")
        may = nodes.where(F.col("ins") * F.col("outs") <= F.col("ins") + F.col("outs") + fill).select("v", rank.alias("rank"))
        sides = left.where("b IS NOT NULL")
        sides = sides.union(sides.select("b", "a")).toDF("v", "near").join(may.toDF("near", "rank"), "near").groupBy("v").agg(F.min("rank").alias("least"))
        chosen = written(may.join(sides, "v", "left").where("least IS NULL OR rank < least").select("v"), "chosen")
        if chosen.isEmpty():
            return left, gone
        from_chosen = written(left.join(chosen.toDF("a"), "a", "left_semi"), "needs")
        rest = left.join(chosen.toDF("a"), "a", "left_anti")
        kept = rest.join(chosen.toDF("b"), "b", "left_anti").select("a", "b")
        bridged = rest.join(chosen.toDF("b"), "b", "left_semi").join(from_chosen.toDF("b", "then"), "b").select("a", F.col("then").alias("b"))
        left = written(kept.union(bridged).distinct(), "needs")
        gone.append(from_chosen)


def cyclic(edges: DataFrame) -> DataFrame:
    """Edges (task, needs) that stand in or behind a cycle: those whose need leads into one. What nothing needs is in no cycle and on no
    way between others, so its edges are set aside. Tasks are taken out by rounds, see ``eliminated``; then, last round first,
    a task leads into a cycle if one of the needs that it had then does."""
    edges = written(edges.select("task", "needs").dropna().distinct(), "needs")
    needed = edges.select(F.col("needs").alias("task")).distinct()
    left, gone = eliminated(edges.join(needed, "task", "left_semi").toDF("a", "b"))
    into = written(left.select("a").distinct(), "into")
    for needs in reversed(gone):
        met = needs.join(into.select(F.col("a").alias("b"), F.lit(True).alias("met")), "b", "left").where("met OR b IS NULL").select("a")
        into = written(into.union(met).distinct(), "into")
    return edges.join(into.toDF("needs"), "needs", "left_semi").select("task", "needs")


def follow(next_edges: DataFrame, seeds: DataFrame, limit: int) -> DataFrame:
    """(seed, node, place) along chains of (node, next), each node with one next, from each of ``seeds`` (node): place 0 is the
    seed. A chain ends at its first repetition or after ``limit`` nodes. Jumps double, so rounds are the logarithm of limit."""
    hops, span = checkpointed(next_edges.select("node", "next")), 1
    reached = seeds.select(F.col("node").alias("seed"), "node", F.lit(0).alias("place")).distinct()
    while span < limit:
        more = reached.join(hops, "node").select("seed", F.col("next").alias("node"), (F.col("place") + span).alias("place")).where(F.col("place") < limit)
        reached = checkpointed(reached.union(more).groupBy("seed", "node").agg(F.min("place").alias("place")))
        hops, span = checkpointed(hops.join(hops.toDF("next", "then"), "next").select("node", F.col("then").alias("next"))), 2 * span
    return reached


def abort(tasks: DataFrame, aborted: DataFrame) -> DataFrame:
    """tasks (task, ns, branch, state) after branches (ns, branch) are aborted: their open tasks are, and ``aborted`` says how many of the
    branch's. Other tasks stay as they are."""
    marked = tasks.join(aborted.select("ns", "branch", F.lit(True).alias("gone")).distinct(), ["ns", "branch"], "left")
    open_ = F.coalesce("gone", F.lit(False)) & F.col("state").isin("pending", "running", "blocked")
    counts = marked.where(open_).groupBy("ns", "branch").agg(F.count("*").alias("aborted"))
    changed = marked.withColumn("state", F.when(open_, "aborted").otherwise(F.col("state"))).drop("gone")
    return changed.join(counts, ["ns", "branch"], "left").withColumn("aborted", F.coalesce("aborted", F.lit(0)))
