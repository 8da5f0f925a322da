"""Operator 5: bytes covered by a long string that also starts earlier are removed.

Every window of ``length`` bytes goes to its minimizer, the smallest hash of its k-byte strings, so equal windows meet
whatever documents they are in. Consecutive windows with one minimizer travel as a run.

1. Runs meet as hashes only. A run whose bytes an earlier run has is a copy from end to end. Copies within a batch of
   documents are settled before the shuffle, so a frequent passage sends one row a batch.
2. First copies of runs that share a minimizer with a different run, or may repeat inside, are fetched with their
   bytes. On a group's concatenation, breadth-first backward extension over the Burrows-Wheeler transform finds the
   common prefix lengths in increasing order and stops at ``length``; what is not found by then lies between suffixes
   that share at least ``length`` bytes. All but the first window of such a class are copies.
3. Each document drops the union of its copies.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, record_batch, slices, stored, with_row_id

#: Bytes in the strings that minimizers are hashes of.
KMER = 24
#: Runs that one minimizer may have in a suffix array; a minimizer with more is settled by hashes of single windows.
MOST_RUNS = 32_000

RUN = "kind int, mh long, sh long, len int, doc_id long, rid long, start int"
_C1, _C2, _C3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def _kmer_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the KMER bytes from each position on."""
    n = len(data) - KMER + 1
    words = np.ndarray((len(data) - 7,), dtype="<u8", buffer=data, strides=(1,))
    h = words[:n] * _C1
    h ^= h >> np.uint64(29)
    h += words[8 : 8 + n] * _C2
    h ^= h >> np.uint64(31)
    h *= _C1
    h += words[16 : 16 + n] * _C3
    h ^= h >> np.uint64(32)
    h *= _C2
    h ^= h >> np.uint64(29)
    return h


def _sliding_min(h: np.ndarray, width: int) -> np.ndarray:
    out, size = h, 1
    while 2 * size <= width:
        out = np.minimum(out[:-size], out[size:])
        size *= 2
    return np.minimum(out[: len(h) - width + 1], out[width - size : len(h) - size + 1]) if size < width else out


def minimizer_runs(data: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first window, number of windows, minimizer, whether it may hold a window twice) of each run in concatenated
    documents that end at ``ends``. A window twice in a run means its minimizer twice, as neighbours among minimizers."""
    none = np.empty(0, dtype=np.int64)
    if len(data) < length:
        return none, none, np.empty(0, dtype=np.uint64), none.astype(bool)
    width = length - KMER + 1
    hashes = _kmer_hashes(data)
    low = _sliding_min(hashes, width)
    at = np.arange(len(low))
    doc = np.searchsorted(ends, at, side="right")
    inside = at + length <= ends[doc]
    edge = np.ones(len(low), dtype=bool)
    edge[1:] = (low[1:] != low[:-1]) | (doc[1:] != doc[:-1]) | (inside[1:] != inside[:-1])
    first = np.flatnonzero(edge)
    count = np.diff(np.append(first, len(low)))
    keep = inside[first]
    first, count = first[keep], count[keep]
    edges = np.full(width - 1, np.iinfo(np.uint64).max)
    highest = ~_sliding_min(np.concatenate([edges, ~low, edges]), width)  # over the windows that hold a position
    places = np.flatnonzero(hashes == highest)
    value = hashes[places]
    twice = np.flatnonzero((value[1:] == value[:-1]) & (np.diff(places) < width))
    marks = np.zeros(len(first) + 1, dtype=np.int64)
    if len(first):
        np.add.at(marks, np.maximum(np.searchsorted(first, places[twice + 1] - width + 1, side="right") - 1, 0), 1)
        np.add.at(marks, np.searchsorted(first, places[twice], side="right"), -1)
    return first, count, low[first], (np.cumsum(marks)[:-1] > 0) | (count > width)


def _merged(start: np.ndarray, end: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unions of spans that touch or overlap; spans come sorted by document and start, with ends that don't fall."""
    if not len(start):
        return start, end, doc
    edge = np.ones(len(start), dtype=bool)
    edge[1:] = (start[1:] > end[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(edge)
    return start[first], end[np.append(first[1:], len(start)) - 1], doc[first]


def _longs(column: pa.Array, missing: int = np.iinfo(np.int64).max) -> np.ndarray:
    return column.cast(pa.int64()).fill_null(missing).to_numpy(zero_copy_only=False)


def _runs(length: int):
    """Documents to rows of RUN: kinds 1 and 2 are first runs of the batch, 2 those that may hold a window twice, kind 0
    spans that an earlier place in the batch has."""

    def run(batches):
        for batch in slices(batches, "data", 4 << 20):
            column = batch.column("data").fill_null(b"")
            size = pc.binary_length(column).to_numpy().astype(np.int64)
            raw = b"".join(column.to_pylist())
            ends = np.cumsum(size)
            first, count, low, twice = minimizer_runs(np.frombuffer(raw, dtype=np.uint8), ends, length)
            if not len(first):
                continue
            span = count + length - 1
            view = memoryview(raw)
            digest = np.array([xxhash.xxh64_intdigest(view[a : a + n]) for a, n in zip(first.tolist(), span.tolist())], dtype=np.uint64)
            doc = np.searchsorted(ends, first, side="right")
            rid, doc_id = batch.column("rid").to_numpy()[doc], batch.column("doc_id")
            order_id = _longs(doc_id)[doc]
            start = first - (ends - size)[doc]
            order = np.lexsort((start, rid, order_id, span, digest, low))
            same = np.zeros(len(order), dtype=bool)
            same[1:] = (low[order][1:] == low[order][:-1]) & (digest[order][1:] == digest[order][:-1]) & (span[order][1:] == span[order][:-1])
            copies = np.sort(order[same])
            a, b, d = _merged(first[copies], (first + span)[copies], doc[copies])
            offset = (ends - size)[d]
            yield record_batch({"kind": pa.array(np.zeros(len(a), dtype=np.int32)), "mh": pa.array(a * 0x9E3779B1 + d), "sh": pa.array(np.zeros(len(a), dtype=np.int64)), "len": pa.array((b - a).astype(np.int32)), "doc_id": pa.nulls(len(a), pa.int64()), "rid": pa.array(batch.column("rid").to_numpy()[d]), "start": pa.array((a - offset).astype(np.int32))})
            new = np.sort(order[~same])
            yield record_batch({"kind": pa.array((1 + twice[new]).astype(np.int32)), "mh": pa.array(low[new].view(np.int64)), "sh": pa.array(digest[new].view(np.int64)), "len": pa.array(span[new].astype(np.int32)), "doc_id": doc_id.take(pa.array(doc[new])), "rid": pa.array(rid[new]), "start": pa.array(start[new].astype(np.int32))})

    return run


def _first_runs():
    """Rows of RUN sorted by (mh, sh, len, doc_id with null last, rid, start): copies of an earlier run become spans
    (kind 0), first runs that have to be compared by their bytes stay (kinds 1 and 2), all other runs go."""
    def run(batches):
        last, alone = None, None  # key of the last run; the only distinct run of its minimizer so far, if not yet passed on
        for batch in batches:
            if batch.num_rows == 0:
                continue
            kind = batch.column("kind").to_numpy()
            yield batch.filter(pa.array(kind == 0))
            batch = batch.filter(pa.array(kind > 0))
            if batch.num_rows == 0:
                continue
            twice = kind[kind > 0] == 2
            mh, sh, n = (batch.column(c).to_numpy() for c in ("mh", "sh", "len"))
            new = np.ones(len(mh), dtype=bool)
            new[1:] = (mh[1:] != mh[:-1]) | (sh[1:] != sh[:-1]) | (n[1:] != n[:-1])
            new[0] = last != (mh[0], sh[0], n[0])
            copies = batch.filter(pa.array(~new))
            if copies.num_rows:
                yield copies.set_column(0, "kind", pa.array(np.zeros(copies.num_rows, dtype=np.int32)))
            firsts = np.flatnonzero(new)
            fm = mh[firsts]
            goes_on = last is not None and last[0] == mh[0]
            group = np.cumsum(np.diff(fm, prepend=fm[:1]) != 0) if len(fm) else fm
            many = np.bincount(group)[group] > 1 if len(fm) else np.empty(0, dtype=bool)
            if goes_on and len(fm) and fm[0] == mh[0]:  # the minimizer had runs in an earlier batch
                many |= group == 0
                if alone is not None:
                    yield alone
                alone = None
            passed = many | twice[firsts]
            yield batch.take(pa.array(firsts[passed]))
            if len(fm) and fm[-1] == mh[-1] and not (goes_on and fm[-1] == mh[0]):
                alone = batch.slice(int(firsts[-1]), 1) if not passed[-1] else None
            elif not goes_on or mh[-1] != mh[0]:
                alone = None
            last = (mh[-1], sh[-1], n[-1])

    return run


def suffix_order(data: np.ndarray, length: int) -> np.ndarray:
    """Positions sorted by at least their next ``length`` bytes: prefix doubling from 8 bytes on."""
    n = len(data)
    padded = np.concatenate([data, np.zeros(8, dtype=np.uint8)])
    key = np.ndarray((n,), dtype=">u8", buffer=padded, strides=(1,)).astype(np.uint64)
    size = 8
    while True:
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        rank = np.empty(n, dtype=np.int64)
        rank[order] = np.cumsum(np.diff(ordered, prepend=ordered[:1]) != 0) + 1
        if size >= length or rank[order[-1]] == n:
            return order
        later = np.zeros(n, dtype=np.int64)
        later[: max(0, n - size)] = rank[size:]
        key = (rank << 32 | later).astype(np.uint64)
        size *= 2


def short_prefixes(data: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """Whether sorted suffixes i - 1 and i share fewer than ``length`` bytes, by interval expansion on the BWT.

    An interval holds the suffixes that start with some string. Level by level, each interval is extended to the left
    by every byte that precedes its suffixes; where the extension's right end is new, the common prefix there has the
    level's length, and the extension is carried on. Levels end at ``length``.
    """
    n = len(data)
    bwt = data[order - 1]  # the byte before; the last byte stands before the first
    lf = np.empty(n, dtype=np.int64)
    lf[np.argsort(bwt, kind="stable")] = np.arange(n)
    known = np.zeros(n + 1, dtype=bool)
    known[[0, n]] = True
    lo, hi = np.array([0]), np.array([n])
    for level in range(length):
        sizes = hi - lo
        total = int(sizes.sum())
        if not total:
            break
        begin = np.cumsum(sizes) - sizes
        at = np.arange(total) - np.repeat(begin - lo, sizes)
        owner = np.repeat(np.arange(len(lo)), sizes)
        key = owner << 8 | bwt[at]
        by = np.argsort(key, kind="stable")
        ends = np.flatnonzero(np.diff(key[by], append=-1))
        starts = np.concatenate([[0], ends[:-1] + 1])
        to = lf[at[by]]
        new_lo, new_hi = to[starts], to[ends] + 1
        fresh = ~known[new_hi]
        known[new_hi[fresh]] = True
        lo, hi = new_lo[fresh], new_hi[fresh]
        if level == 0:  # the whole's extensions are the single bytes; the last of them ends at n, which is known
            lo, hi = new_lo, new_hi
    return known[:n]


def repeated_windows(runs: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray]:
    """(run, window, class) as arrays run << 32 | window and class, of all windows whose bytes occur more than once."""
    joined = np.frombuffer(b"\xff".join(runs) + b"\xff", dtype=np.uint8)  # no UTF-8 text has this byte
    order = suffix_order(joined, length)
    known = short_prefixes(joined, order, length)
    sizes = np.array([len(x) for x in runs]) + 1
    begin = np.cumsum(sizes) - sizes
    run = np.searchsorted(begin, order, side="right") - 1
    window = order - begin[run]
    valid = window + length <= sizes[run] - 1
    label = np.cumsum(known)
    label, run, window = label[valid], run[valid], window[valid]
    several = np.bincount(label, minlength=1)[label] > 1
    return run[several] << 32 | window[several], label[several]


def _compared(length: int, most: int = 2 << 20):
    """Rows (mh, doc_id, rid, start, data) sorted by mh, whole minimizers taken together, to spans of repeated windows."""

    def settle(rows: pa.Table):
        data = rows.column("data").to_pylist()
        at, label = repeated_windows(data, length)
        run, window = at >> 32, at & 0xFFFFFFFF
        doc_id, rid, start = (_longs(rows.column(c).combine_chunks()) for c in ("doc_id", "rid", "start"))
        place = start[run] + window
        order = np.lexsort((place, rid[run], doc_id[run], label))
        later = np.zeros(len(order), dtype=bool)
        later[1:] = label[order][1:] == label[order][:-1]
        gone = order[later]
        gone = gone[np.lexsort((place[gone], rid[run[gone]]))]
        a, b, d = _merged(place[gone], place[gone] + length, rid[run[gone]])
        return record_batch({"rid": pa.array(d), "start": pa.array(a.astype(np.int32)), "len": pa.array((b - a).astype(np.int32))})

    def run(batches):
        held, size = [], 0
        for batch in batches:
            if batch.num_rows == 0:
                continue
            held.append(batch)
            size += batch.column("data").nbytes
            if size < most:
                continue
            rows = pa.Table.from_batches(held)
            mh = rows.column("mh").to_numpy()
            cut = int(np.searchsorted(mh, mh[-1]))  # the last minimizer may go on in the next batch
            if cut:
                yield settle(rows.slice(0, cut))
                held = rows.slice(cut).combine_chunks().to_batches()
                size = sum(x.column("data").nbytes for x in held)
        if held:
            yield settle(pa.Table.from_batches(held))

    return run


def _cut_out(length: int):
    def run(batches):
        for batch in slices(batches, "data", 4 << 20):
            rows = {"doc_id": batch.column("doc_id"), "n_bytes": [], "n_removed": [], "n_spans": [], "spans": [], "kept": []}
            for data, spans in zip(batch.column("data").to_pylist(), batch.column("spans").to_pylist()):
                union: list[list[int]] = []
                for s in sorted(spans or [], key=lambda s: s["start"]):
                    a, b = s["start"], s["start"] + s["len"]
                    if union and a <= union[-1][1]:
                        union[-1][1] = max(b, union[-1][1])
                    else:
                        union.append([a, b])
                edges = [0, *(x for u in union for x in u), len(data)]
                rows["n_bytes"].append(len(data))
                rows["n_removed"].append(sum(b - a for a, b in union))
                rows["n_spans"].append(len(union))
                rows["spans"].append([{"start": a, "end": b} for a, b in union])
                rows["kept"].append(b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2])))
            types = {"n_bytes": pa.int64(), "n_removed": pa.int64(), "n_spans": pa.int64(), "spans": pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), "kept": pa.binary()}
            yield record_batch({"rid": batch.column("rid")} | {c: pa.array(v, types[c]) if c in types else v for c, v in rows.items()})

    return run


def repeated_spans(texts: DataFrame, length: int, most_runs: int = MOST_RUNS) -> DataFrame:
    """Spans (rid, start, len) of the rows (rid, doc_id, data) that are covered by an earlier string of ``length`` bytes."""
    runs = map_arrow(texts, _runs(length), RUN)
    met = runs.repartition("mh").sortWithinPartitions("mh", "sh", "len", F.col("doc_id").asc_nulls_last(), "rid", "start")
    settled = stored(map_arrow(met, _first_runs(), RUN), "runs")
    wanted = settled.where("kind > 0").select("mh", "rid", "start", "len")
    hot = stored(wanted.groupBy("mh").count().where(F.col("count") > most_runs).select("mh"), "hot")
    per_doc = wanted.groupBy("rid").agg(F.collect_list(F.struct("mh", "start", "len")).alias("wanted"))  # no more than a document has bytes
    data = texts.join(per_doc, "rid").select("rid", "doc_id", "data", F.explode("wanted").alias("w"))
    data = data.select("w.mh", "doc_id", "rid", "w.start", F.expr("substring(data, w.start + 1, w.len)").alias("data"))
    few = data
    spans = settled.where("kind = 0").select("rid", "start", "len")
    if not hot.isEmpty():
        few = data.join(hot, "mh", "left_anti")
        spans = spans.union(_single_windows(data.join(hot, "mh", "left_semi"), length))
    found = map_arrow(few.repartition("mh").sortWithinPartitions("mh"), _compared(length), "rid long, start int, len int")
    return spans.union(found)


def _single_windows(data: DataFrame, length: int) -> DataFrame:
    """For minimizers with very many runs: windows meet by a 128-bit hash; the first of a hash stays, the others are spans."""

    def run(batches):
        for batch in batches:
            for mh, doc_id, rid, start, raw in zip(*(batch.column(c).to_pylist() for c in ("mh", "doc_id", "rid", "start", "data"))):
                view = memoryview(raw)
                each = [xxhash.xxh3_128_digest(view[i : i + length]) for i in range(len(raw) - length + 1)]
                n = len(each)
                yield record_batch({"hash": pa.array(each, pa.binary()), "doc_id": pa.array([doc_id] * n, pa.int64()), "rid": pa.array([rid] * n, pa.int64()), "start": pa.array(np.arange(start, start + n, dtype=np.int32))})

    windows = stored(map_arrow(data, run, "hash binary, doc_id long, rid long, start int").distinct(), "windows")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid", "start")
    first = windows.groupBy("hash").agg(F.min(place).alias("first"))
    return windows.join(first, "hash").where(~place.eqNullSafe(F.col("first"))).select("rid", "start", F.lit(length).alias("len"))


def remove_repeats(docs: DataFrame, *, length: int = 100, most_runs: int = MOST_RUNS, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(rid, doc_id, n_bytes, n_removed, n_spans, spans array<start, end>, kept binary) for each row of docs.

    Null texts are empty. Order is by doc_id, null last, then by row for repeated ids. Texts shorter than ``length``
    lose nothing; matches never cross documents; other columns are ignored; an empty table gives no rows.
    ``length`` is at least 2 * KMER.
    """
    if length < 2 * KMER:
        raise ValueError(f"length must be at least {2 * KMER}")
    picked = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.coalesce(F.col(text_column).cast("binary"), F.lit(b"")).alias("data"))
    whole = with_row_id(picked, "doc_id", "data")
    spans = repeated_spans(whole, length, most_runs).groupBy("rid").agg(F.collect_list(F.struct("start", "len")).alias("spans"))
    joined = whole.join(spans, "rid", "left")
    return map_arrow(joined, _cut_out(length), "rid long, doc_id long, n_bytes long, n_removed long, n_spans long, spans array<struct<start:bigint,end:bigint>>, kept binary")


def digests(removed: DataFrame) -> DataFrame:
    return removed.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
