"""Search inside texts: documents that hold given strings anywhere, found through an inverted index of character trigrams."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def grams(text: Column, size: int = 3) -> Column:
    """Distinct runs of ``size`` characters. Each start modulo ``size`` gives a list of runs side by side."""
    runs = [F.regexp_extract_all(text if i == 0 else F.substr(text, F.lit(i + 1)), F.lit(f"(?s)(.{{{size}}})"), 1) for i in range(size)]
    return F.array_distinct(F.concat(*runs))


def _asked_grams(needles: Column) -> Column:
    """The trigrams of the strings; strings too short for one give themselves, if there are no others."""
    long = F.flatten(F.transform(needles, lambda x: grams(x)))
    return F.array_distinct(F.when(F.size(long) > 0, long).otherwise(needles))


def candidates(queries: DataFrame, docs: DataFrame) -> DataFrame:
    """(query_id, doc_id) of documents (doc_id, t) that may hold all ``needles`` of a query (query_id, needles): those with the
    rarest trigram among them. No document that holds all of them is left out.

    Two passes over the documents: one counts the asked trigrams, summed before they are shuffled; one finds the documents
    of each query's rarest, so postings of common trigrams are never written. A trigram of no document ends its query.
    """
    asked = queries.select("query_id", F.explode(_asked_grams(F.col("needles"))).alias("gram"))
    lengths = sorted(r[0] for r in asked.select(F.char_length("gram")).distinct().collect())  # 1, 2 or 3
    each = docs.select("doc_id", F.explode(F.concat(F.array().cast("array<string>"), *(grams(F.col("t"), n) for n in lengths))).alias("gram"))
    df = each.join(asked.select("gram").distinct(), "gram", "left_semi").groupBy("gram").agg(F.count("*").alias("df"))
    known = asked.join(df, "gram", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    rarest = known.groupBy("query_id").agg(F.min(F.struct("df", "gram")).alias("r")).where("r.df > 0").select("query_id", "r.gram")
    return rarest.join(each, "gram").select("query_id", "doc_id")


def holding(queries: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of queries and docs, for each pair in which the text ``t`` holds all ``needles`` (none are empty), anywhere."""
    queries = queries.where(F.size("needles") > 0)
    met = candidates(queries, docs).join(docs, "doc_id").join(queries, "query_id")
    return met.where(F.forall("needles", lambda x: F.contains(F.col("t"), x)))


def chunks_with_carry(pairs: DataFrame, size: int, carry: int) -> DataFrame:
    """pairs with a row for each chunk of ``size`` characters of ``text``: its number ``chunk``, its ``part`` led by the last ``carry``
    characters of what stands before, and ``first``, how many characters of the text stand before the part."""
    last = F.floor((F.greatest(F.char_length("text"), F.lit(1)) - 1) / size).cast("int")
    c = pairs.select("*", F.explode(F.sequence(F.lit(0), last)).alias("chunk")).withColumn("first", F.greatest(F.lit(0), F.col("chunk") * size - carry))
    return c.withColumn("part", F.substring("text", F.col("first") + 1, F.col("chunk") * size + size - F.col("first")))


def bytes_before(characters: Column) -> Column:
    return F.octet_length(F.substring("text", F.lit(1), characters))


def all_terms(queries: DataFrame, docs: DataFrame, most: int, *, size: int = 1 << 20, carry: int = 2048, before: int = 240, after: int = 760) -> DataFrame:
    """(query_id, doc_id, chunk, byte_start, byte_end, window_hash): places where a stretch of a document holds all of a query's terms.

    Terms are what white space parts, in lower case, and count wherever they stand, inside words too. A text is read in
    chunks, each led by the end of the one before. Each chunk with all terms gives a window from ``before`` characters
    ahead of the first occurrence of any to ``after`` past it; the ``most`` first of a document stay.
    """
    q = queries.select("query_id", F.array_distinct(F.filter(F.split(F.lower("text"), r"(?U)\s+"), lambda x: x != "")).alias("needles"))
    d = docs.where("text IS NOT NULL").select("doc_id", "text", F.lower("text").alias("t"))
    c = chunks_with_carry(holding(q, d), size, carry).withColumn("low", F.lower("part")).where(F.forall("needles", lambda x: F.contains(F.col("low"), x)))
    place = F.array_min(F.transform("needles", lambda x: F.call_function("locate", x, F.col("low")))) - 1
    c = c.withColumn("start", F.greatest(F.lit(0), place - before)).withColumn("end", F.least(F.char_length("part"), place + after))
    c = c.withColumn("n", F.row_number().over(Window.partitionBy("query_id", "doc_id").orderBy("chunk"))).where(F.col("n") <= most)
    window = F.substring("part", F.col("start") + 1, F.col("end") - F.col("start"))
    return c.select("query_id", "doc_id", "chunk", bytes_before(F.col("first") + F.col("start")).alias("byte_start"), bytes_before(F.col("first") + F.col("end")).alias("byte_end"), F.sha2(window, 256).alias("window_hash"))


#: Fixed values of the ranking: what stands before and after a match, occurrences looked at for each term, and bounds of a weight.
BEFORE, AFTER, OCCURRENCES, LEAST_WEIGHT, MOST_WEIGHT, EXACT = 240, 1000, 8, 2, 96, 1_000_000
TOKEN = regex.compile(r"[\p{L}\p{N}_-]+")


def _places(text: str, needle: str) -> list[int]:
    """Where needle stands in text, without overlaps, the first few."""
    out, at = [], text.find(needle)
    while at >= 0 and len(out) < OCCURRENCES:
        out.append(at)
        at = text.find(needle, at + len(needle))
    return out


def ranked_places(text: str, query: str, most: int) -> list[tuple[str, float, int, int]]:
    """(kind, score, start, end) of the best windows: the query's exact words, else its terms by what else stands around them."""
    low, phrase = text.lower(), unicodedata.normalize("NFKC", query).lower().strip()
    around = lambda at, n: (max(0, at - BEFORE), min(len(text), at + n + AFTER))
    if not phrase:
        return []
    exact = [("exact", float(EXACT + len(phrase)), *around(at, len(phrase))) for at in _places(low, phrase)]
    if exact:
        return exact
    tokens = sorted(dict.fromkeys(t for t in TOKEN.findall(phrase) if len(t) >= 2), key=len, reverse=True)
    weight = {t: min(MOST_WEIGHT, max(LEAST_WEIGHT, len(t))) for t in tokens}
    found = []
    for token in tokens:
        for at in _places(low, token):
            a, b = around(at, len(token))
            inside = [t for t in tokens if t in low[a:b]]
            found.append(("lexical", sum(map(weight.get, inside)) + 100 * len(inside) / len(tokens), a, b))
    return sorted(found, key=lambda x: -x[1])[:most]


def anchored(requests: DataFrame, *, most: int = 5, size: int = 1 << 20, carry: int = 1024) -> DataFrame:
    """requests (query_id, doc_id, query, text) to (query_id, doc_id, n, chunk, kind, score, byte_start, byte_end, window_hash): the
    ``most`` best windows of the text asked. Each chunk, led by the end of the one before, is ranked by itself; windows of the same
    bytes count once; equal scores go by place, then by chunk. Null texts and queries find nothing.
    """
    chunked = chunks_with_carry(requests.where("text IS NOT NULL AND query IS NOT NULL"), size, carry)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(q, d, c, first, i, *hit) for q, d, c, first, query, part in f.itertuples(index=False) for i, hit in enumerate(ranked_places(part, query, 2 * most))]
            yield pd.DataFrame(rows, columns=["query_id", "doc_id", "chunk", "first", "place", "kind", "score", "start", "end"])

    asked = chunked.select(F.col("query_id").cast("long").alias("query_id"), F.col("doc_id").cast("long").alias("doc_id"), "chunk", "first", "query", "part")
    found = asked.mapInPandas(run, "query_id long, doc_id long, chunk int, first int, place int, kind string, score double, start int, end int")
    found = found.select("*", (F.col("first") + F.col("start")).alias("a"), (F.col("first") + F.col("end")).alias("b"))
    once = found.groupBy("query_id", "doc_id", "a", "b").agg(F.min(F.struct(-F.col("score"), "chunk", "place", "kind")).alias("h"))
    w = Window.partitionBy("query_id", "doc_id").orderBy("h.col1", "a", "h.chunk", "h.place")
    best = once.withColumn("n", F.row_number().over(w)).where(F.col("n") <= most)
    texts = requests.select(F.col("query_id").cast("long").alias("query_id"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = best.join(texts, ["query_id", "doc_id"])
    window = F.substring("text", F.col("a") + 1, F.col("b") - F.col("a"))
    return out.select("query_id", "doc_id", "n", F.col("h.chunk").alias("chunk"), F.col("h.kind").alias("kind"), F.round(-F.col("h.col1"), 6).alias("score"), bytes_before(F.col("a")).alias("byte_start"), bytes_before(F.col("b")).alias("byte_end"), F.sha2(window, 256).alias("window_hash"))
