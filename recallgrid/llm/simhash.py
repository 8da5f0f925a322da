"""Operator 3: SimHash near-duplicates, found at anchor points of a covering code.

A fingerprint is cut into three blocks, so fingerprints within 4 bits agree in some block but for one bit. In each
block 15 bits are held against the perfect Hamming code (every point is within 1 of a codeword), the other bits are
taken as they are; block, other bits and codeword name an anchor. A fingerprint is at home at its own anchor, within
the covering radius 1, and visits every anchor within that radius plus the block's threshold 1. So of two fingerprints
within 4 bits, each visits the other's home in some block, and it is enough to compare homes with visitors.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER_ASCII, map_arrow, record_batch, row_id, slices, stored, texts, with_row_id
from .components import components

#: First bit and width of each block; 15 of its bits are coded, the rest are exact.
BLOCKS = ((0, 21), (21, 21), (42, 22))
CODED = 15
THRESHOLD = 4


def shingle_hashes(text: str, words: int, seed: int) -> np.ndarray:
    """XXH64 of each run of ``words`` words, A-Z lower-cased, words joined by a space; of all words if there are fewer."""
    found = text.encode().translate(LOWER_ASCII).split()
    if not found:
        return np.empty(0, dtype=np.uint64)
    joined, digest = b" ".join(found), xxhash.xxh64_intdigest
    if len(found) <= words:
        return np.array([digest(joined, seed)], dtype=np.uint64)
    lengths = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    n = len(found) - words + 1
    return np.array([digest(joined[a:b], seed) for a, b in zip(starts[:n].tolist(), ends[words - 1 :].tolist())], dtype=np.uint64)


def fingerprint(text: str, words: int = 4, seed: int = 42) -> int:
    """Bit i is set if it is set in over half the shingle hashes; 0 for a text without words."""
    h = shingle_hashes(text, words, seed)
    if not len(h):
        return 0
    counts = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, *, words: int = 5, seed: int = 42, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(rid, doc_id, fp): a row number and the fingerprint, as a signed long, of each row's whole text (null: empty)."""

    def run(batches):
        for batch in slices(batches, most=4 << 20):
            fp = np.array([fingerprint(t, words, seed) for t in texts(batch)], dtype=np.uint64)
            yield record_batch({"rid": batch.column("rid"), "doc_id": batch.column("doc_id"), "fp": pa.array(fp.view(np.int64))})

    picked = with_row_id(docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text")), "doc_id", "text")
    return map_arrow(picked, run, "rid long, doc_id long, fp long")


def _syndrome(x: np.ndarray) -> np.ndarray:
    """XOR of the places (1 to 15) of the bits set in 15-bit numbers: 0 for codewords, else the bit to flip."""
    s = np.zeros_like(x)
    for i in range(1, CODED + 1):
        s ^= (x >> (i - 1) & 1) * i
    return s


def anchors(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index into fp, anchor, whether at home) for every anchor that each unsigned fingerprint has or visits."""
    at, to, home = [], [], []
    every = np.arange(len(fp))
    for block, (first, width) in enumerate(BLOCKS):
        bits = (fp >> np.uint64(first)).astype(np.int64) & ((1 << width) - 1)
        coded, exact = bits & ((1 << CODED) - 1), bits >> CODED
        s = _syndrome(coded)
        own = np.where(s > 0, coded ^ (1 << np.maximum(s - 1, 0)), coded)
        name = lambda code, rest: block << 40 | rest << CODED | code  # noqa: E731, B023
        at.append(every), to.append(name(own, exact)), home.append(np.ones(len(fp), dtype=bool))
        for i in range(1, CODED + 1):  # two flips i and j with i ^ j = s lead to another codeword
            j = s ^ i
            some = (j > i) & (s > 0)
            at.append(every[some]), to.append(name(coded[some] ^ (1 << (i - 1)) ^ (1 << (j[some] - 1)), exact[some]))
            home.append(np.zeros(some.sum(), dtype=bool))
        for i in range(width - CODED):
            at.append(every), to.append(name(own, exact ^ (1 << i))), home.append(np.zeros(len(fp), dtype=bool))
    return np.concatenate(at), np.concatenate(to), np.concatenate(home)


def links(homes: np.ndarray, members: np.ndarray, most: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Edges that connect what home-member pairs within ``most`` bits connect; not more than a few per member in dense groups."""
    if len(homes) * len(members) <= 4096:
        i, j = np.nonzero(np.bitwise_count(homes[:, None] ^ members) <= most)
        return [(homes[i], members[j])]
    out, rest = [], homes
    while len(rest):
        seed, queue, rest, free = rest[0], [rest[0]], rest[1:], members
        while queue and (len(free) or len(rest)):
            h = queue.pop()
            near = np.bitwise_count(free ^ h) <= most
            if near.any():
                out.append((np.full(near.sum(), seed), free[near]))
                free = free[~near]
            near = np.bitwise_count(rest ^ h) <= most
            if near.any():  # these homes need not be members of this call
                out.append((np.full(near.sum(), seed), rest[near]))
                queue.extend(rest[near])
                rest = rest[~near]
    return out


def _meet(most: int):
    """Rows sorted by anchor and part, homes first; a group may reach over batches: its homes are kept, its members stream."""

    def run(batches):
        key, homes = None, np.empty(0, dtype=np.uint64)
        for batch in batches:
            if batch.num_rows == 0:
                continue
            anchor, part, fp, away = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("anchor", "part", "fp", "away"))
            fp = fp.view(np.uint64)
            edges = [0, *(np.flatnonzero((np.diff(anchor) != 0) | (np.diff(part) != 0)) + 1).tolist(), len(fp)]
            out = []
            for a, b in zip(edges, edges[1:]):
                own = fp[a : a + int((away[a:b] == 0).sum())]
                goes_on = key == (anchor[a], part[a])
                key, homes = (anchor[a], part[a]), np.concatenate([homes, own]) if goes_on else own
                if len(homes) and (b - a > 1 or goes_on):
                    out += links(homes, fp[a:b], most)
            if out:
                u, v = np.concatenate([x for x, _ in out]), np.concatenate([y for _, y in out])
                pair = np.unique(np.stack([np.maximum(u, v), np.minimum(u, v)])[:, u != v], axis=1)
                yield record_batch({"u": pa.array(pair[0].view(np.int64)), "v": pa.array(pair[1].view(np.int64))})

    return run


def link_fingerprints(distinct: DataFrame, *, most: int = THRESHOLD, split: int = 4096) -> DataFrame:
    """Edges (u, v) between the distinct fingerprints ``fp`` that connect all that are within ``most`` (4 or fewer) bits.

    An anchor with more than ``split`` homes is dealt out: its homes over parts, its visitors to each part. A home also
    visits the parts other than its own, so that homes of one anchor meet whatever their parts.
    """
    if not 0 <= most <= THRESHOLD:
        raise ValueError(f"the covering of three blocks holds up to {THRESHOLD} bits, not {most}")

    def spread(only_homes: bool):
        def run(batches):
            for batch in batches:
                fp = batch.column("fp").to_numpy().view(np.uint64)
                for a in range(0, len(fp), 20_000):
                    some = fp[a : a + 20_000]
                    at, to, home = anchors(some)
                    if only_homes:
                        yield record_batch({"anchor": pa.array(to[home])})
                    else:
                        yield record_batch({"anchor": pa.array(to), "fp": pa.array(some[at].view(np.int64)), "away": pa.array(1 - home.astype(np.int32))})

        return run

    hot = map_arrow(distinct, spread(True), "anchor long").groupBy("anchor").count().where(F.col("count") > split)
    hot = stored(hot.select("anchor", F.ceil(F.col("count") / split).cast("int").alias("parts")), "hot")
    spread_out = map_arrow(distinct, spread(False), "anchor long, fp long, away int")
    if hot.isEmpty():
        dealt = spread_out.withColumn("part", F.lit(0))
    else:
        parts = F.coalesce("parts", F.lit(1))
        own = F.when(F.col("away") == 0, F.pmod(F.xxhash64("fp"), parts).cast("int")).otherwise(-1)
        places = spread_out.join(hot, "anchor", "left").select("anchor", "fp", own.alias("own"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
        dealt = places.select("anchor", "fp", (F.col("own") != F.col("part")).cast("int").alias("away"), "part")
    met = dealt.repartition("anchor", "part").sortWithinPartitions("anchor", "part", "away")
    return map_arrow(met, _meet(most), "u long, v long")


def near_duplicates(docs: DataFrame, *, words: int = 5, seed: int = 42, most: int = THRESHOLD, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(rid, doc_id, fp, root, component_id) for each row of docs; root is the smallest fingerprint that links reach.

    component_id is the smallest doc_id that links reach, the row's own included; null if all of them are null. Texts
    without words, null ones too, have fingerprint 0 and are linked like any other. Repeated rows share everything;
    other columns are ignored; an empty table gives no rows. Copies meet in one aggregate with map-side combination;
    only distinct fingerprints are linked, as edges that connect each group and not as all of its pairs.
    """
    prints = stored(fingerprints(docs, words=words, seed=seed, id_column=id_column, text_column=text_column), "fingerprints")
    distinct = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("low")), "distinct")
    root = components(link_fingerprints(distinct.select("fp"), most=most)).toDF("fp", "root")
    joined = distinct.join(root, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    lowest = joined.groupBy("root").agg(F.min("low").alias("component_id"))
    group = joined.select("fp", "root").join(lowest, "root")
    return prints.join(group, "fp").select("rid", "doc_id", "fp", "root", "component_id")


def keep_first(docs: DataFrame, *, words: int = 5, seed: int = 42, most: int = THRESHOLD, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """docs with one row of each group: the one with the smallest id (null last), the first of repeated rows; all columns stay."""
    groups = stored(near_duplicates(docs, words=words, seed=seed, most=most, id_column=id_column, text_column=text_column), "groups")
    gone = F.col("doc_id").isNull()
    first = groups.groupBy("root").agg(F.min(F.struct(gone, "doc_id", "rid")).alias("least"))
    kept = first.select(F.col("least.rid").alias("__rid"))
    return row_id(docs).join(kept, "__rid", "left_semi").drop("__rid")
