"""Fusion, gates, scores and selection over candidate tables (query_id, doc_id, ...)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Weights of the facets of a scope; fixed values.
FACETS = {"repository": 1.0, "project": 0.9, "task": 0.85, "topic": 0.75, "environment": 0.7, "capability": 0.65, "workspace": 0.5, "session": 0.25}
HIDDEN = ("superseded", "conflicted", "tombstoned", "rejected")


def best_first(*ties: str) -> Window:
    return Window.partitionBy("query_id").orderBy(F.desc("score"), *ties)


def fuse(lanes: DataFrame, constant: int = 60) -> DataFrame:
    """Weighted reciprocal rank fusion of (query_id, lane, weight, rank, doc_id): sum of weight / (constant + rank).

    Ties keep the order of first sight: the smallest (lane, rank). ``signals`` lists the lanes, by number.
    """
    fused = lanes.groupBy("query_id", "doc_id").agg(
        F.round(F.sum(F.col("weight") / (constant + F.col("rank"))), 9).alias("score"),
        F.min(F.struct("lane", "rank")).alias("seen"),
        F.array_sort(F.collect_set("lane")).alias("signals"),
    )
    return fused.withColumn("position", F.row_number().over(best_first("seen"))).drop("seen")


def boundary_gate(kind: Column, namespace: Column, boundary: Column, local: Column) -> Column:
    """Why the security boundary turns a hit away; null if it lets it pass."""
    scoped = F.contains(namespace, F.lit("::"))
    knowledge = F.when(scoped & ~F.startswith(namespace, F.concat(boundary, F.lit("::"))), "security:knowledge-scope-mismatch").when(~scoped & ~local, "security:unscoped-legacy-knowledge")
    return F.when(kind != "memory", knowledge).when(namespace != boundary, "security:scope-mismatch")


def differs(a: Column, b: Column) -> Column:
    """Known on both sides and unequal; unknown sides are neutral."""
    return F.coalesce(a != b, F.lit(False))


def status_gate(status: Column, historical: Column) -> Column:
    return F.when(~historical & status.isin(*HIDDEN), F.concat(F.lit("temporal:"), status))


def branch_gate(state: Column, branch_local: Column, own: Column, current: Column) -> Column:
    return F.when((state == "hypothesis") & branch_local & ~own.eqNullSafe(current), "branch:unverified-hypothesis")


def affinity(match: dict[str, Column]) -> Column:
    """Weighted mean of the facets' matches (0 to 1, null where a facet doesn't apply); 1 if none applies."""
    weight = sum((F.when(match[f].isNotNull(), w).otherwise(0.0) for f, w in FACETS.items() if f in match), F.lit(0.0))
    total = sum((F.coalesce(match[f] * w, F.lit(0.0)) for f, w in FACETS.items() if f in match), F.lit(0.0))
    return F.when(weight == 0, 1.0).otherwise(total / weight)


def version(text: Column) -> Column:
    """array<int> of a version's three parts, missing parts 0; null without a number."""
    part = lambda i: F.coalesce(F.nullif(F.regexp_extract(text, r"v?(\d+)(?:\.(\d+))?(?:\.(\d+))?", i), F.lit("")).cast("int"), F.lit(0))
    return F.when(text.rlike(r"\d"), F.array(part(1), part(2), part(3)))


def runtime_gate(want: dict[str, Column], have: dict[str, Column]) -> tuple[Column, Column]:
    """(reason or null, multiplier) of a record's runtime constraints against the environment; all may be null.

    Repository, project, package manager, runtime and version are hard; another system or architecture halves, an
    unknown environment costs 0.35, no constraints at all 0.1.
    """
    hard = F.when(differs(want["repository"], have["repository"]), "runtime-constraint:repository-mismatch").when(differs(want["project"], have["project"]), "runtime-constraint:project-mismatch")
    soft = F.lit(1.0)
    for facet in ("os", "architecture"):
        other = F.coalesce(~F.array_contains(want[facet], have[facet]), F.lit(False))
        hard = hard.when(other & F.coalesce(want[f"strict_{facet}"], F.lit(False)), f"environment:{facet}-mismatch")
        soft = soft * F.when(other, 0.5).otherwise(1.0)
    hard = hard.when(differs(want["package_manager"], have["package_manager"]), "environment:package-manager-mismatch").when(differs(want["runtime"], have["runtime"]), "environment:runtime-mismatch")
    own = version(have["runtime_version"])
    outside = F.coalesce(own < version(want["version_min"]), F.lit(False)) | F.coalesce(own > version(want["version_max"]), F.lit(False))
    hard = hard.when(outside, "environment:runtime-version-mismatch")
    unknown = sum(((want[f].isNotNull() & have[f].isNull()).cast("int") for f in ("os", "package_manager", "runtime")), F.lit(0)) > 0
    none = F.coalesce(*(c.cast("string") for c in want.values())).isNull()
    return hard, F.when(none, 0.9).when(hard.isNotNull(), 0.0).otherwise(soft * F.when(unknown, 0.65).otherwise(1.0))


def trust(kind: Column, authority: Column, has_evidence: Column) -> Column:
    return F.when(kind == "knowledge", authority / 100).otherwise(F.greatest(F.lit(0.1), authority / 100) * F.when(has_evidence, 1.0).otherwise(0.6))


def gated(score: Column, multiplier: Column, weight: Column) -> Column:
    return score * F.greatest(F.lit(0.0), 1 + (multiplier - 1) * weight)


def authority_and_freshness(score: Column, authority: Column, updated: Column, now: int, weight: float = 0.1) -> Column:
    """0.65 of the score, a quarter of the authority, and a freshness that halves in 30 days; milliseconds."""
    days = F.greatest(F.lit(0.0), (F.lit(now) - F.coalesce(updated, F.lit(now))) / 86_400_000)
    return score * 0.65 + authority / 100 * 0.25 + weight / (1 + days / 30)


def cap(hits: DataFrame, most: int, *ties: str) -> DataFrame:
    return hits.withColumn("rank", F.row_number().over(best_first(*ties))).where(F.col("rank") <= most)


def structural_dedupe(hits: DataFrame, *content: str, tie: str) -> DataFrame:
    """One hit of each query and content: the best, the first of equals."""
    w = Window.partitionBy("query_id", *content).orderBy(F.desc("score"), tie)
    return hits.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def lexical_floor(score: Column, has_text_signal: Column, floor: float = 0.04) -> Column:
    return F.when(has_text_signal, F.greatest(score, F.lit(floor))).otherwise(score)


def adaptive_cutoff(hits: DataFrame, *ties: str, focused: bool = True, floor: float = 0.04) -> DataFrame:
    """The leading hits of each query, up to a gap, a low share of the top score, or the floor."""
    ratio, gap, share = (0.7, 0.12, 0.24) if focused else (0.68, 0.14, 0.18)
    w = best_first(*ties)
    top, before = F.first("score").over(w), F.lag("score").over(w)
    stop = (top < floor) | (F.col("score") < floor) | F.coalesce(before - F.col("score") >= F.greatest(F.lit(gap), top * share), F.lit(False)) | (F.col("score") / top < ratio)
    stopped = F.max(F.col("__stop").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return hits.withColumn("__stop", stop).withColumn("__stopped", stopped).where("__stopped = 0").drop("__stop", "__stopped")


def mmr(hits: DataFrame, limit: int, weight: float = 0.75) -> DataFrame:
    """hits (query_id, doc_id, score, position, terms) reordered by marginal relevance: ``mmr_rank`` from 1, and the
    ``similarity`` to what was chosen before. Hits are capped per query before; queries are independent."""

    def choose(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("position").reset_index(drop=True)
        sets, score = [set(t) for t in group["terms"]], group["score"].to_list()
        near, left, order, similarity = [0.0] * len(group), list(range(len(group))), [], []
        while left and len(order) < limit:
            pick = max(left, key=lambda i: (weight * score[i] - (1 - weight) * near[i], -i))
            left.remove(pick)
            order.append(pick)
            similarity.append(near[pick])
            for i in left:
                union = len(sets[i] | sets[pick])
                near[i] = max(near[i], len(sets[i] & sets[pick]) / union if union else 0.0)
        out = group.loc[order, ["query_id", "doc_id", "score"]].copy()
        out["mmr_rank"], out["similarity"] = range(1, len(order) + 1), similarity
        return out

    kind = dict(hits.dtypes)
    return hits.groupBy("query_id").applyInPandas(choose, f"query_id {kind['query_id']}, doc_id {kind['doc_id']}, score double, mmr_rank int, similarity double")


def pack_context(hits: DataFrame, *, total: int, knowledge: int, memory: int) -> DataFrame:
    """hits (query_id, doc_id, kind, density, cost, position) that fit, in order of density: each is taken unless it
    would pass the whole budget or its kind's. Hits are capped per query before; one fold per query."""
    row = F.struct((-F.col("density")).alias("d"), F.col("position").alias("p"), "doc_id", "kind", F.col("cost").cast("long").alias("cost"))
    lists = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(row)).alias("xs"))
    kind = dict(hits.dtypes)["doc_id"]
    zero = F.lit(0).cast("long")
    state = F.struct(zero.alias("t"), zero.alias("k"), zero.alias("m"), F.array().cast(f"array<{kind}>").alias("out"))

    def step(a, x):
        is_k, is_m = x["kind"] == "knowledge", x["kind"] == "memory"
        fits = (a["t"] + x["cost"] <= total) & ~(is_k & (a["k"] + x["cost"] > knowledge)) & ~(is_m & (a["m"] + x["cost"] > memory))
        add = lambda c, on: a[c] + F.when(fits & on, x["cost"]).otherwise(zero)
        return F.struct(add("t", F.lit(True)).alias("t"), add("k", is_k).alias("k"), add("m", is_m).alias("m"), F.when(fits, F.concat(a["out"], F.array(x["doc_id"]))).otherwise(a["out"]).alias("out"))

    kept = lists.select("query_id", F.posexplode(F.aggregate("xs", state, step, lambda a: a["out"])).alias("place", "doc_id"))
    return hits.join(kept, ["query_id", "doc_id"])


def min_max_per_batch(hits: DataFrame) -> DataFrame:
    """``normal``: relevance brought to 0..1 within its query and batch; 1 where a batch is constant."""
    w = Window.partitionBy("query_id", "batch")
    low, high = F.min("relevance").over(w), F.max("relevance").over(w)
    return hits.withColumn("normal", F.when(high == low, 1.0).otherwise((F.col("relevance") - low) / (high - low)))


def tournament(hits: DataFrame, *, most: int, budget: int) -> DataFrame:
    """hits (query_id, doc_id, score, tokens, batch, relevance, final_relevance) with ``final_round`` and ``blended``.

    Of each batch the ``most`` most relevant go on. Where a query has several batches and those rows fit ``budget`` tokens
    together, they are judged once more in one batch, by final_relevance; else relevance is brought to 0..1 by batch.
    Rows that don't go on have no relevance.
    """
    best = Window.partitionBy("query_id", "batch").orderBy(F.desc("relevance"), "doc_id")
    winners = hits.withColumn("__n", F.row_number().over(best)).where(F.col("__n") <= most)
    rounds = winners.groupBy("query_id").agg(((F.sum("tokens") <= budget) & (F.count_distinct("batch") > 1)).alias("final_round"))
    judged = min_max_per_batch(winners).join(rounds, "query_id")
    relevance = F.when(F.col("final_round"), F.col("final_relevance")).otherwise(F.col("normal"))
    judged = judged.select("query_id", "doc_id", "final_round", relevance.alias("judged"))
    out = hits.join(judged, ["query_id", "doc_id"], "left").withColumn("final_round", F.coalesce("final_round", F.lit(False)))
    return out.withColumn("blended", 0.7 * F.coalesce("judged", F.lit(0.0)) + 0.3 * F.col("score"))
