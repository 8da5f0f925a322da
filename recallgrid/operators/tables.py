"""Knowledge tables: upserts, deletes, incremental maintenance, vectors."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written


def upsert(table: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """table with the rows of changes in place of those with the same key. Both have one row a key."""
    return table.join(changes.select(key), key, "left_anti").unionByName(changes)


def delete(table: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return table.join(keys.select(key), key, "left_anti")


def fetch(requests: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Rows for the requested keys; each request stays, with nulls where its key isn't there."""
    return requests.join(table, key, "left")


def compare(old: DataFrame, new: DataFrame, key: str, fingerprint: str) -> DataFrame:
    """(key, action): insert, update, unchanged or remove."""
    o, n = old.select(key, F.col(fingerprint).alias("was")), new.select(key, F.col(fingerprint).alias("now"))
    action = F.when(F.col("was").isNull(), "insert").when(F.col("now").isNull(), "remove").when(F.col("was") == F.col("now"), "unchanged").otherwise("update")
    return o.join(n, key, "full_outer").select(key, action.alias("action"))


def valid_vector(v: Column, dims: int) -> Column:
    return v.isNotNull() & (F.size(v) == dims) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def unit(v: Column) -> Column:
    """The vector at length 1; null for a zero vector."""
    n = norm(v)
    return F.when(n > 0, F.transform(v, lambda x: x.cast("double") / n))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """List column of one length as rows of length 1."""
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    return flat / np.sqrt((flat * flat).sum(axis=1, keepdims=True))


def _block_top(k: int):
    def run(asked: pa.Table, block: pa.Table) -> pa.Table:
        ids, names = block.column("doc_id").to_numpy(), asked.column("query_id").to_numpy()
        found = {"query_id": [], "doc_id": [], "score": []}
        if len(ids) and len(names):
            q, d = _matrix(asked.column("q")), _matrix(block.column("d"))
            for first in range(0, len(q), 256):
                scores = np.round(q[first : first + 256] @ d.T, 9)
                bar = -np.partition(-scores, min(k, len(ids)) - 1, axis=1)[:, min(k, len(ids)) - 1]
                for name, score, least in zip(names[first : first + 256], scores, bar):
                    at = np.flatnonzero(score >= least)
                    at = at[np.lexsort((ids[at], -score[at]))][:k]
                    found["query_id"].append(np.full(len(at), name)), found["doc_id"].append(ids[at]), found["score"].append(score[at])
        return pa.table({c: pa.array(np.concatenate(v) if v else np.empty(0), pa.float64() if c == "score" else pa.int64()) for c, v in found.items()})

    return run


def top_cosine(queries: DataFrame, corpus: DataFrame, k: int, *, within: Sequence[str] = (), per_block: int = 16_384) -> DataFrame:
    """(query_id, doc_id, score, rank): the k most similar rows of corpus (doc_id, v) for each of queries (query_id, v).

    The corpus is dealt into blocks of about ``per_block`` rows and each query goes to every block, where one matrix
    product scores them and k rows a query are kept; no vectors are broadcast. ``within`` names columns that have to be
    equal; what is equal there has blocks of its own. Vectors have one length; null, zero and non-finite ones take no
    part. Ties go to the smaller doc_id.
    """
    usable = F.coalesce(norm(F.col("v")), F.lit(0.0))
    queries, corpus = (x.where((usable > 0) & (usable < float("inf"))) for x in (queries, corpus))
    if within:
        count = corpus.groupBy(*within).count().where(F.col("count") > per_block)
        many = count.select(*within, F.ceil(F.col("count") / per_block).cast("int").alias("blocks"))  # as few as rows / per_block
        queries, corpus = (x.join(F.broadcast(many), [*within], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))) for x in (queries, corpus))
    else:
        blocks = F.lit(max(1, -(-corpus.count() // per_block))).alias("blocks")
        queries, corpus = (x.select("*", blocks) for x in (queries, corpus))
    left = queries.select(F.col("query_id").cast("long").alias("query_id"), *(F.col(c).alias(c) for c in within), F.col("v").alias("q"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    right = corpus.select(F.col("doc_id").cast("long").alias("doc_id"), *(F.col(c).alias(c) for c in within), F.col("v").alias("d"), F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int").alias("block"))
    best = left.groupBy("block", *within).cogroup(right.groupBy("block", *within)).applyInArrow(_block_top(k), "query_id long, doc_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k)


def inverted_index(docs: DataFrame, terms: Column, asked: DataFrame) -> DataFrame:
    """(term, doc_id, length, tf) of the terms in ``asked`` (term); length counts all terms of the text. Only asked terms are
    shuffled."""
    each = docs.select("doc_id", terms.alias("ts")).select("doc_id", F.size("ts").alias("length"), F.explode("ts").alias("term"))
    return each.join(asked.distinct(), "term", "left_semi").groupBy("term", "doc_id", "length").agg(F.count("*").alias("tf"))


def full_text(queries: DataFrame, docs: DataFrame, terms: Column, k: int, *, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(query_id, doc_id, score, rank): documents with all of a query's terms, the k best by BM25.

    queries has (query_id, term), docs what ``terms`` is computed from. A document can only have all terms of a query if it
    has the rarest, so it is looked up by that one, and the others meet it by term and document. Texts are read once, into a
    stored table of the asked terms' postings and every document's length, which all that follows reads.
    """
    asked = queries.distinct()
    counted = asked.select("term").union(asked.sparkSession.createDataFrame([("",)], "term string"))  # a row a document, for its length
    index = written(inverted_index(docs.where(F.size(terms) > 0), F.array_append(terms, F.lit("")), counted).withColumn("length", F.col("length") - 1), "postings")
    n, average = index.where("term = ''").agg(F.count("*"), F.avg("length")).first()
    index = index.where("term <> ''")
    df = index.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.lit(float(n)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    known = asked.join(df, "term", "left").withColumn("idf", idf)
    per = Window.partitionBy("query_id")
    known = known.withColumn("wanted", F.count("*").over(per)).withColumn("have", F.count("df").over(per)).where("wanted = have")
    rarest = known.groupBy("query_id", "wanted").agg(F.min_by("term", F.struct("df", "term")).alias("term"))
    found = rarest.join(index.select("term", "doc_id", "length"), "term").select("query_id", "wanted", "doc_id", "length")
    hits = found.join(known.select("query_id", "term", "idf"), "query_id").join(index.select("term", "doc_id", "tf"), ["term", "doc_id"])
    part = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.lit(float(average or 1))))
    scored = hits.groupBy("query_id", "doc_id", "wanted").agg(F.count("*").alias("met"), F.round(F.sum(part), 6).alias("score")).where("met = wanted")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id"))
    return scored.select("query_id", "doc_id", "score", rank.alias("rank")).where(F.col("rank") <= k)


def _slots(dims: int):
    """Batches (doc_id, text) of lower-case texts to rows (doc_id, counts): how many of a text's trigrams fall into each slot. A trigram of
    characters below 256 is looked up in a table, hashed when it is first met; others are hashed once a piece of text. A null text
    counts one in place ``dims``."""

    def hashed(grams: np.ndarray) -> np.ndarray:
        texts = ("".join(chr(int(g) >> s & 0x1FFFFF) for s in (42, 21, 0)) for g in grams)
        return np.array([int.from_bytes(hashlib.sha256(t.encode()).digest()[:4], "little") % dims for t in texts], dtype=np.int16)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.full(1 << 24, -1, dtype=np.int16)

        def slots(c: np.ndarray) -> np.ndarray:
            """The slots of the trigrams that start at each character but the last two."""
            a, b, c = c[:-2], c[1:-1], c[2:]
            plain = (a | b | c) < 256
            place = np.where(plain, a << 16 | b << 8 | c, 0).astype(np.int32)
            out = np.where(plain, table[place], -1)
            new = np.flatnonzero(out < 0)
            if len(new):
                grams, at = np.unique(a[new].astype(np.int64) << 42 | b[new].astype(np.int64) << 21 | c[new], return_inverse=True)
                found = hashed(grams)
                out[new] = found[at]
                table[place[new[plain[new]]]] = out[new[plain[new]]]
            return out

        for batch in batches:
            ids, counts = [], []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                if text is None or len(text) < 3:  # one run, of the whole text
                    n = np.zeros(dims + 1, dtype=np.int64)
                    n[dims if text is None else int.from_bytes(hashlib.sha256(text.encode()).digest()[:4], "little") % dims] = 1
                else:
                    c = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
                    n = sum(np.bincount(slots(c[i : i + (1 << 20) + 2]), minlength=dims + 1) for i in range(0, len(c) - 2, 1 << 20))
                ids.append(doc_id), counts.append(n)
            if ids:
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1, dtype=np.int32) * (dims + 1)), pa.array(np.concatenate(counts)))
                yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.field("doc_id").type), lists], names=["doc_id", "counts"])

    return run


def trigram_vectors(docs: DataFrame, dims: int) -> DataFrame:
    """(doc_id, slot, weight): a stand-in embedding. Each run of three characters counts in the slot that the first four
    bytes of its SHA-256, low byte first, give mod ``dims``; lengths are 1. A null text has a null slot, a short one is one run."""
    texts = docs.select("doc_id", F.lower("text").alias("text"))
    rows = texts.mapInArrow(_slots(dims), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, counts array<bigint>").repartition("doc_id")
    each = rows.select("doc_id", F.posexplode("counts").alias("slot", "n")).where("n > 0")
    slots = each.groupBy("doc_id", F.nullif(F.col("slot").cast("long"), F.lit(dims)).alias("slot")).agg(F.sum("n").alias("n"))
    length = F.sqrt(F.sum(F.col("n") * F.col("n")).over(Window.partitionBy("doc_id")))
    return slots.select("doc_id", "slot", (F.col("n") / length).alias("weight"))


def next_fit(items: DataFrame, order: str, tokens: str, *, most_items: int, most_tokens: int | str, by: str) -> DataFrame:
    """items with ``batch``: in order, a batch is closed when the next item would pass either bound (``most_tokens`` may name a
    column). The items of each ``by`` stream by in order, so none of them is held together."""
    kinds = ", ".join(f"`{n}` {t}" for n, t in items.dtypes)

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, batch, n, spent = None, -1, 0, 0
        for frame in frames:
            bounds = frame[most_tokens].tolist() if isinstance(most_tokens, str) else [most_tokens] * len(frame)
            out = []
            for own, size, bound in zip(frame[by].tolist(), frame[tokens].tolist(), bounds):
                if own != key:
                    key, batch, n = own, -1, most_items
                if n >= most_items or spent + size > bound:
                    batch, n, spent = batch + 1, 0, 0
                n, spent = n + 1, spent + size
                out.append(batch)
            yield frame.assign(batch=np.array(out, dtype=np.int32))

    return items.repartition(by).sortWithinPartitions(by, order).mapInPandas(fold, f"{kinds}, batch int")
