"""Replay of ranking policies over recorded retrieval cases."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def replay(cases: DataFrame, policies: DataFrame) -> DataFrame:
    """(policy_id, case_id, selected): what each policy would have picked for each case.

    cases: (case_id, features array<struct<id, score, tokens, authority, terms>>), a bounded list. policies: a handful
    of rows (policy_id, min_authority, top, most, weight, budget). Each case is paired with each policy by exploding the
    policies into it, and pairs are picked for apart: filter by authority, cap, marginal relevance, then by density
    into the budget, and the first ``top``.
    """
    rows = [r.asDict() for r in policies.collect()]  # a handful: the variants of one search step
    listed = F.array(*(F.struct(*(F.lit(v).alias(k) for k, v in r.items())) for r in rows))
    pairs = cases.select("case_id", "features", F.explode(listed.cast(_listed_type(policies))).alias("p"))

    def pick(batches):
        for batch in batches:
            chosen = [_pick(list(f), p) for f, p in zip(batch["features"], batch["p"])]
            yield pd.DataFrame({"policy_id": [p["policy_id"] for p in batch["p"]], "case_id": batch["case_id"], "selected": chosen})

    kinds = dict(cases.dtypes) | dict(policies.dtypes)
    return pairs.mapInPandas(pick, f"policy_id {kinds['policy_id']}, case_id {kinds['case_id']}, selected array<bigint>")


def _listed_type(policies: DataFrame) -> str:
    return "array<struct<" + ",".join(f"{k}:{t}" for k, t in policies.dtypes) + ">>"


def _pick(features: list, policy: dict) -> list[int]:
    hits = sorted((f for f in features if f["authority"] >= policy["min_authority"]), key=lambda f: (-f["score"], f["id"]))[: policy["most"]]
    sets, left, order = {f["id"]: set(f["terms"]) for f in hits}, list(hits), []

    def redundancy(f):
        unions = [(len(sets[f["id"]] & sets[g["id"]]), len(sets[f["id"]] | sets[g["id"]])) for g in order]
        return max((a / b if b else 0.0 for a, b in unions), default=0.0)

    while left:
        best = max(left, key=lambda f: (policy["weight"] * f["score"] - (1 - policy["weight"]) * redundancy(f), -f["id"]))
        left.remove(best)
        order.append(best)
    spent, kept = 0, set()
    for f in sorted(order, key=lambda f: -f["score"] / max(1, f["tokens"])):
        if spent + f["tokens"] <= policy["budget"]:
            spent += f["tokens"]
            kept.add(f["id"])
    return [int(f["id"]) for f in order if f["id"] in kept][: policy["top"]]


def replay_scores(picked: DataFrame, cases: DataFrame) -> DataFrame:
    """(policy_id, score, coverage, forbidden): 0.6 recall of positives + 0.4 coverage of evidence - exposure of what is
    forbidden, over all cases together."""
    j = picked.join(cases.select("case_id", "positive", "evidence", "forbidden"), "case_id")
    hit = lambda c: F.sum(F.size(F.array_intersect("selected", c)))
    size = lambda c: F.greatest(F.lit(1), F.sum(F.size(c)))
    coverage, exposed = hit("evidence") / size("evidence"), hit("forbidden") / size("selected")
    score = 0.6 * hit("positive") / size("positive") + 0.4 * coverage - exposed
    return j.groupBy("policy_id").agg(F.round(score, 9).alias("score"), F.round(coverage, 9).alias("coverage"), F.round(exposed, 9).alias("forbidden"))


#: Steps of one round of the search, and the bounds of each parameter; fixed values.
STEPS = (("top", 2), ("top", -2), ("most", 5), ("most", -5), ("weight", 0.05), ("weight", -0.05), ("budget", 256), ("budget", -256))
BOUNDS = {"top": (1, 100), "most": (1, 100), "weight": (0.5, 1.0), "budget": (128, 16_000)}
POLICY = "policy_id int, min_authority int, top int, most int, weight double, budget int"


def variants(base: dict) -> list[dict]:
    """The base policy and eight that differ from it in one parameter, kept in its bounds."""
    moved = lambda k, d: min(BOUNDS[k][1], max(BOUNDS[k][0], round(base[k] + d, 9)))
    return [base | {"policy_id": 0}, *(base | {"policy_id": i + 1, k: moved(k, d)} for i, (k, d) in enumerate(STEPS))]


def accepted(scores: dict[int, tuple[float, float, float]]) -> int | None:
    """Of {policy: (score, coverage, forbidden)} the variant with the best score that beats policy 0, exposes nothing forbidden
    and covers no less evidence; the first of equals. None if there is none or if policy 0 itself exposes something."""
    base = scores[0]
    safe = [(-s, i) for i, (s, c, f) in scores.items() if i and f == 0 and c >= base[1] and s > base[0]]
    return min(safe)[1] if safe and base[2] == 0 else None


def search(cases: DataFrame, base: dict, rounds: int) -> DataFrame:
    """(round, policy_id, min_authority, top, most, weight, budget, score, coverage, forbidden, accepted): a coordinate search of at
    most ``rounds`` steps. Nine policies are replayed over all cases in each; only their nine scores come to the driver."""
    spark, out = cases.sparkSession, []
    for number in range(rounds):
        tried = variants(base)
        policies = spark.createDataFrame([tuple(v[k.split()[0]] for k in POLICY.split(", ")) for v in tried], POLICY)
        rows = {r["policy_id"]: (r["score"], r["coverage"], r["forbidden"]) for r in replay_scores(replay(cases, policies), cases).collect()}
        if not rows:
            break
        best = accepted(rows)
        out += [(number, *(v[k.split()[0]] for k in POLICY.split(", ")), *rows[v["policy_id"]], v["policy_id"] == best) for v in tried]
        if best is None:
            break
        base = tried[best]
    return spark.createDataFrame(out, f"round int, {POLICY}, score double, coverage double, forbidden double, accepted boolean")


def regressed():
    """Whether weighted means pass a bound; fixed values."""
    return (F.col("failures") > 0.1) | (F.col("mismatch") > 0.005) | (F.col("latency") > 1200) | (F.col("corrections") > 0.1)


def ewma(metrics: DataFrame, key: str, order: str, columns: list[str], alpha: float = 0.25) -> DataFrame:
    """Exponentially weighted means of each key's metrics in order, by one fold per key over its daily rows."""
    row = F.struct(F.col(order).alias("o"), *(F.col(c).cast("double").alias(c) for c in columns))
    lists = metrics.groupBy(key).agg(F.array_sort(F.collect_list(row)).alias("xs"))

    def mean(c: str):
        step = lambda a, x: F.when(a.isNull(), x[c]).otherwise(alpha * x[c] + (1 - alpha) * a)
        return F.aggregate("xs", F.lit(None).cast("double"), step).alias(c)

    return lists.select(key, *map(mean, columns))
