"""Operator 7: token counts without ids. Pieces are counted once per distinct pre-token; the counts meet the
per-document pre-token frequencies at the pre-token, and are summed per document.
"""

from __future__ import annotations

import functools
import zlib
from array import array
from collections import Counter

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import Bounded, list_array, map_arrow, record_batch, slices, texts, with_place

#: Pre-tokens are dealt out over so many buckets for each shuffle partition; a task streams by, so a bucket's size is not bound
#: by memory. A pre-token found in HOT_SHARE of a batch's documents goes to a bucket that depends on the batch too: its
#: frequencies are salted, and it is counted once for each batch at most.
WIDTH, HOT_SHARE = 8, 1 / 64


def _pack(terms: list[bytes], lists: np.ndarray, idx: np.ndarray, n: np.ndarray) -> bytes:
    """Pre-tokens, how many documents each has, those documents' places in the batch and the frequencies, compressed."""
    lengths = np.fromiter(map(len, terms), dtype="<u4", count=len(terms))
    raw = b"".join([np.array([len(terms), len(idx), lengths.sum()], dtype="<u4").tobytes(), lengths.tobytes(), lists.astype("<u4").tobytes(), idx.astype("<u4").tobytes(), n.astype("<u4").tobytes(), *terms])
    return len(raw).to_bytes(4, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _unpack(blob: bytes) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    raw = pa.decompress(blob[4:], decompressed_size=int.from_bytes(blob[:4], "little"), codec="zstd", asbytes=True)
    n_terms, n_entries, n_text = np.frombuffer(raw, dtype="<u4", count=3).tolist()
    numbers = np.frombuffer(raw, dtype="<u4", offset=12, count=2 * n_terms + 2 * n_entries)
    ends = np.cumsum(numbers[:n_terms]).tolist()
    text = raw[len(raw) - n_text :]
    terms = [text[a:b].decode() for a, b in zip([0, *ends], ends)]
    lists, rest = numbers[n_terms : 2 * n_terms], numbers[2 * n_terms :]
    return terms, lists, rest[:n_entries], rest[n_entries:]


@functools.cache
def tokenizer(path: str) -> Tokenizer:
    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


class Pretokens:
    """Cuts text into units that the tokenizer encodes one by one: pre-tokens, and special strings where it knows them."""

    def __init__(self, path: str, pattern: str):
        special = [t.content for t in tokenizer(path).get_added_tokens_decoder().values()]
        self.special = special
        self.cut = regex.compile("(" + "|".join(map(regex.escape, special)) + ")") if special else None
        self.pattern = regex.compile(pattern)

    def of(self, text: str) -> list[str]:
        if not self.cut or not any(s in text for s in self.special):
            return self.pattern.findall(text)
        parts = self.cut.split(text)
        return [p for i, part in enumerate(parts) for p in ([part] if i % 2 else self.pattern.findall(part))]

    def chunks(self, text: str) -> list[str]:
        """Stretches that no pre-token crosses: each single space between other characters starts one; else the whole text."""
        if text and text.replace("\n", " ").split(" ") == text.split() and not any(s in text for s in self.special if " " in s):
            first, *rest = text.split(" ")
            return [first, *[" " + chunk for chunk in rest]]
        return [text] if text else []


def _postings(path: str, pattern: str, buckets: int):
    """Per batch of documents, a row for each bucket of pre-tokens, and one with the documents' own columns."""

    def run(batches):
        units = Pretokens(path, pattern)
        for batch in slices(batches, most=24 << 20):
            base, rows = batch.column("rid")[0].as_py(), texts(batch)
            found: dict[str, int] = {}
            ids, freq, lens = array("i"), array("i"), []
            for text in rows:
                counted = Counter(units.chunks(text))
                lens.append(len(counted))
                for chunk in counted:
                    if chunk not in found:
                        found[chunk] = len(found)
                ids.extend(map(found.__getitem__, counted))
                freq.extend(counted.values())
            parts = [units.of(chunk) for chunk in found]
            terms: dict[str, int] = {}
            flat = np.array([terms.setdefault(p, len(terms)) for part in parts for p in part], dtype=np.int64)
            size = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))
            del parts, found
            ids, freq = np.frombuffer(ids, dtype=np.int32), np.frombuffer(freq, dtype=np.int32)
            each = size[ids]
            place = np.arange(each.sum()) + np.repeat((np.cumsum(size) - size)[ids] - (np.cumsum(each) - each), each)
            names = [t.encode() for t in terms]
            bucket = np.fromiter(map(zlib.crc32, names), dtype=np.int64, count=len(names))
            key = flat[place] << 32 | np.repeat(np.repeat(np.arange(len(rows)), lens), each)
            order = np.argsort(key, kind="stable")
            key, weight = key[order], np.repeat(freq, each)[order]
            edge = np.flatnonzero(np.diff(key, prepend=-1))
            n, key = np.add.reduceat(weight, edge) if len(edge) else weight, key[edge]
            lists = np.bincount(key >> 32, minlength=len(names))
            bucket = (bucket + np.where(lists >= max(2, HOT_SHARE * len(rows)), base, 0)) % buckets
            start = np.cumsum(lists) - lists
            by = np.argsort(bucket, kind="stable")
            edges = np.searchsorted(bucket[by], np.arange(buckets + 1))
            blobs, used = [], np.flatnonzero(np.diff(edges))
            for i in used:
                own = by[edges[i] : edges[i + 1]]
                sizes = lists[own]
                at = np.arange(sizes.sum()) + np.repeat(start[own] - (np.cumsum(sizes) - sizes), sizes)
                blobs.append(_pack([names[j] for j in own.tolist()], sizes, key[at] & 0xFFFFFFFF, n[at]))
            for a in range(0, len(used), 128):
                some = used[a : a + 128]
                yield record_batch({"bucket": pa.array(some.astype(np.int32)), "base": pa.array(np.full(len(some), base)), "blob": pa.array(blobs[a : a + 128], pa.binary()), "doc_id": pa.nulls(len(some), pa.list_(pa.int64())), "n_bytes": pa.nulls(len(some), pa.list_(pa.int64()))})
            span = np.array([0, len(rows)])
            n_bytes = pa.array([len(t.encode()) for t in rows], pa.int64())
            yield record_batch({"bucket": pa.array([base % buckets], pa.int32()), "base": pa.array([base], pa.int64()), "blob": pa.nulls(1, pa.binary()), "doc_id": list_array(batch.column("doc_id"), span), "n_bytes": list_array(n_bytes, span)})

    return run


def _partial_sums(path: str):
    """Rows sorted by batch: each pre-token is counted when first met, then remembered; a row of sums per batch."""

    def run(batches):
        t = tokenizer(path)
        pieces = Bounded(lambda term: len(t.encode(term, add_special_tokens=False).ids), 1_000_000)
        base, sums = None, np.zeros(0, dtype=np.int64)

        def row():
            return record_batch({"base": pa.array([base], pa.int64()), "sums": list_array(pa.array(sums), np.array([0, len(sums)])), "doc_id": pa.nulls(1, pa.list_(pa.int64())), "n_bytes": pa.nulls(1, pa.list_(pa.int64()))})

        for batch in batches:
            for i, blob in enumerate(batch.column("blob")):
                if not blob.is_valid:
                    none = pa.nulls(1, pa.list_(pa.int64()))
                    yield record_batch({"base": batch.column("base").slice(i, 1), "sums": none, "doc_id": batch.column("doc_id").slice(i, 1), "n_bytes": batch.column("n_bytes").slice(i, 1)})
                    continue
                if (own := batch.column("base")[i].as_py()) != base:
                    if base is not None:
                        yield row()
                    base, sums = own, np.zeros(0, dtype=np.int64)
                    pieces.trim()
                terms, lists, idx, n = _unpack(blob.as_py())
                new = [x for x in terms if x not in pieces]
                pieces.update(zip(new, (len(e.ids) for e in t.encode_batch_fast(new, add_special_tokens=False))))
                count = np.fromiter(map(pieces.__getitem__, terms), dtype=np.int64, count=len(terms))
                got = np.bincount(idx, np.repeat(count, lists) * n, minlength=len(sums)).astype(np.int64)
                got[: len(sums)] += sums
                sums = got
        if base is not None:
            yield row()

    return run


def _totals(batches):
    """Rows sorted by batch: adds up a batch's sums and gives its documents."""
    base, sums, doc_id, n_bytes = None, np.zeros(0, dtype=np.int64), None, None

    def rows():
        total = np.zeros(len(doc_id), dtype=np.int64)
        total[: len(sums)] = sums
        return record_batch({"doc_id": doc_id, "n_bytes": n_bytes, "n_tokens": pa.array(total)})

    for batch in batches:
        for i, own in enumerate(batch.column("base").to_pylist()):
            if own != base:
                if base is not None:
                    yield rows()
                base, sums = own, np.zeros(0, dtype=np.int64)
            if batch.column("doc_id")[i].is_valid:
                doc_id, n_bytes = batch.column("doc_id")[i].values, batch.column("n_bytes")[i].values
                continue
            got = batch.column("sums")[i].values.to_numpy()
            more, less = (got.copy(), sums) if len(got) > len(sums) else (sums, got)
            more[: len(less)] += less
            sums = more
    if base is not None:
        yield rows()


def count_tokens(docs: DataFrame, path: str, pattern: str, *, limit: int = 512, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for each row of docs.

    Null and empty texts have 0 bytes and 0 tokens; a null id stays null; repeated rows are counted apart; other columns
    are ignored. Special strings inside a text count as the tokenizer takes them. docs is read once, as a table scan.
    Shuffled: for each batch of documents its distinct pre-tokens with their documents, then sums per batch and task.
    """
    picked = with_place(docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text")), "doc_id", "text")
    buckets = WIDTH * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    postings = map_arrow(picked, _postings(path, pattern, buckets), "bucket int, base long, blob binary, doc_id array<long>, n_bytes array<long>")
    sums = map_arrow(postings.repartition("bucket").sortWithinPartitions("base", "bucket"), _partial_sums(path), "base long, sums array<long>, doc_id array<long>, n_bytes array<long>")
    total = map_arrow(sums.repartition("base").sortWithinPartitions("base"), _totals, "doc_id long, n_bytes long, n_tokens long")
    return total.withColumn("over_limit", F.col("n_tokens") > limit)
