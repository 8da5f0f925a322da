"""Joins of term sets by similarity: prefix filter over a global order by rarity, with length and position filters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _least(threshold: float, size: Column) -> Column:
    """The least whole number of shared terms that reaches the threshold of ``size``."""
    return F.greatest(F.lit(1), F.ceil(threshold * size - 1e-9).cast("int"))


def _placed(sets: DataFrame, order: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A row for each term of each set, with its place in order of rarity and the size of the set."""
    each = sets.select("id", *keys, F.size("terms").alias("n"), F.explode("terms").alias("term")).join(order, "term")
    return each.withColumn("place", F.row_number().over(Window.partitionBy("id", *keys).orderBy("df", "term"))).drop("df")


def candidates(left: DataFrame, right: DataFrame, threshold: float, *, of: str, within: Sequence[str] = ()) -> DataFrame:
    """(id, other, *within): pairs that may share ``threshold`` of the terms of the larger set (of="larger") or of the smaller one
    (of="smaller"); no pair that does is left out.

    Pairs that share k terms meet at one of the n - k + 1 rarest terms of a set of n. For the larger set's share that holds for
    both sets; for the smaller's only for the smaller set, which then meets all terms of the other. A pair whose sizes differ
    too much, or that has too few terms left behind the place where it meets, is dropped there.
    """
    keys = list(within)
    both = left.select("terms").union(right.select("terms"))
    order = both.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    l, r = _placed(left, order, keys), _placed(right, order, keys).withColumnsRenamed({"id": "other", "n": "m", "place": "spot"})  # noqa: E741
    reach = lambda size: size - _least(threshold, size) + 1
    n, m = F.col("n"), F.col("m")
    need = _least(threshold, F.greatest(n, m) if of == "larger" else F.least(n, m))
    if of == "larger":
        l, r = l.where(F.col("place") <= reach(n)), r.where(F.col("spot") <= reach(m))
        fits = F.least(n, m) >= need
    else:
        fits = F.when(n <= m, F.col("place") <= reach(n)).otherwise(F.col("spot") <= reach(m))
    enough = F.least("place", "spot") + F.least(n - F.col("place"), m - F.col("spot")) >= need
    return l.join(r, ["term", *keys]).where(fits & enough).select("id", "other", *keys).distinct()


def similar(left: DataFrame, right: DataFrame, threshold: float, *, of: str, within: Sequence[str] = (), only: str = "true") -> DataFrame:
    """(id, other, *within, n, m, shared) of the pairs of sets (id, terms, *within) that share ``threshold`` or more of the larger
    or the smaller set's terms. terms are distinct; empty and null sets have no pairs; ids are unique in each scope. ``only`` is
    a condition on id and other."""
    met = candidates(left, right, threshold, of=of, within=within).where(only)
    whole = met.join(left.select("id", *within, "terms"), ["id", *within]).join(right.select(F.col("id").alias("other"), *within, F.col("terms").alias("others")), ["other", *within])
    whole = whole.select("id", "other", *within, F.size("terms").alias("n"), F.size("others").alias("m"), F.size(F.array_intersect("terms", "others")).alias("shared"))
    size = F.greatest("n", "m") if of == "larger" else F.least("n", "m")
    return whole.where(F.col("shared") >= _least(threshold, size))


def sharing(left: DataFrame, right: DataFrame, within: Sequence[str] = (), only: str = "true") -> DataFrame:
    """(id, other, n, m, shared) of all pairs of sets that share a term, so that a set's nearest is there however far; ids are those of
    ``unique``, ``only`` is a condition on the plain ids. Keys stay numbers: pairs are many."""
    l = left.select("id.id", "id.copy", *within, F.size("terms").alias("n"), F.explode("terms").alias("term"))  # noqa: E741
    r = right.select(F.col("id.id").alias("other"), F.col("id.copy").alias("again"), *within, F.size("terms").alias("m"), F.explode("terms").alias("term"))
    pairs = l.join(r, [*within, "term"]).where(only).groupBy("id", "copy", "other", "again", *within)
    return pairs.agg(F.first("n").alias("n"), F.first("m").alias("m"), F.count("*").alias("shared")).select("id", "other", "n", "m", "shared")


def unique(sets: DataFrame, *order: str) -> DataFrame:
    """sets with (id, copy) for id: rows of one id are told apart by their place in ``order``, so that odd tables' repeated ids don't mix."""
    return sets.withColumn("id", F.struct("id", F.row_number().over(Window.partitionBy("id").orderBy(*order)).alias("copy")))


def meeting(queries: DataFrame, docs: DataFrame, within: Sequence[str], only: str) -> DataFrame:
    """(query_id, id, shared): how many terms a query and a document of its scope share; pairs without a shared term aren't formed."""
    q = queries.select("query_id", *within, "at", F.explode("terms").alias("term"))
    d = docs.select("id", *within, F.col("at").alias("when"), F.explode("terms").alias("term"))
    return q.join(d, [*within, "term"]).where(only).groupBy("query_id", "id").agg(F.count("*").alias("shared"))


def strongest(queries: DataFrame, docs: DataFrame, k: int, *, of: str, within: Sequence[str], only: str) -> DataFrame:
    """(query_id, id, shared): of queries (query_id, at, terms, *within) and docs (id, at, terms, *within, ``of``) the pairs that share as
    many terms as the k-th best distinct ``of`` of a query, or more; none that ties with it is left out. ``only`` is a condition on
    ``at``, a query's place, and ``when``, a document's.

    A quarter of the documents, by hash, is counted in full and bounds the k-th best from below. Let that bound be b: who shares
    only the b - 1 most frequent terms can't reach it, so the others are looked up by the remaining terms alone, and only
    those found are counted. A query that finds fewer than k in the quarter is looked up by all its terms.
    """
    keys = list(within)
    df = docs.select(*keys, F.explode("terms").alias("term")).groupBy(*keys, "term").agg(F.count("*").alias("df"))
    each = queries.select("query_id", "at", *keys, F.explode("terms").alias("term")).join(df, [*keys, "term"])
    each = each.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("df", "term")))
    postings = docs.select("id", *keys, of, F.col("at").alias("when"), F.explode("terms").alias("term"))
    some = each.join(postings.where(F.pmod(F.xxhash64("id"), F.lit(4)) == 0), [*keys, "term"]).where(only).groupBy("query_id", "id", of).agg(F.count("*").alias("shared"))
    distinct = some.groupBy("query_id", of).agg(F.max("shared").alias("shared")).withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("shared"))))
    bound = distinct.where(F.col("r") == k).select("query_id", F.col("shared").alias("bound"))
    last = F.max("place").over(Window.partitionBy("query_id"))
    asked = each.withColumn("last", last).join(bound, "query_id", "left").where(F.col("place") <= F.col("last") - F.coalesce("bound", F.lit(1)) + 1)
    found = asked.join(postings, [*keys, "term"]).where(only).select("query_id", "id").distinct()
    whole = found.join(queries.select("query_id", F.col("terms").alias("qs")), "query_id").join(docs.select("id", "terms"), "id")
    counted = whole.select("query_id", "id", F.size(F.array_intersect("qs", "terms")).alias("shared")).join(bound, "query_id", "left")
    return counted.where(F.col("shared") >= F.coalesce("bound", F.lit(1))).drop("bound")
