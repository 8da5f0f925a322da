"""Operator 4: language-model scores by a probabilistic suffix tree over words, beside a unigram base.

A text is its words, A-Z lower-cased, and an end mark. A context is the last one, two, up to ``depth`` words before a word; contexts
don't reach over a text's start, which is a word of its own there. A symbol that a context was followed by at least twice is
kept with its count; symbols met once only add to the mass that the context leaves to its suffix:

    P(w | context) = (count of w if kept + (count of symbols not kept + 1) * P(w | suffix)) / (size of the context + 1)

The empty context is the unigram base. A context is retained if its distribution diverges from its suffix's by more than its
kept symbols cost; else its suffix stands for it. So what is retained grows with the corpus. A score is the base plus, for
each word, what the retained contexts along its longest one add.

Words are numbered by a dictionary of all that training holds twice or more, the most frequent ``vocabulary`` of them; other words
are in no context and never kept, but count in the base. The tree is never in one place: every position goes to the bucket
of the word before it, where all contexts that end in that word are counted and scored. A context too frequent for one bucket
(hot) is gathered in a table before, and its positions are dealt out by the next word to the left, or by document where the
context is as long as they get; their buckets ask the table for what they meet.
"""

from __future__ import annotations

import zlib
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER_ASCII, give_back, list_array, map_arrow, record_batch, slices, stored, with_row_id

END, START = b"\n", b"\n\n"  # no word holds a line feed
#: Positions that a bucket is to hold, how often a context may occur before it is dealt out, and how many such contexts of a
#: length there can be: more text raises the bound. Their sizes go through the driver, some 300 bytes each.
BUCKET, HOT, MOST_HOT = 1_000_000, 1_000_000, 1 << 17
SLICE = 250_000  # positions of a bucket that are counted at a time, or all of one word
#: Words in the dictionary: 16 bytes each where it is broadcast.
VOCABULARY = 1 << 21
OTHER, FIRST = 0, 1  # codes of words that the dictionary doesn't hold, and of a text's start
BATCH = 10 << 20


def fold(doc_id: int | None, parts: int) -> int:
    """crc32 of the id as text (null: empty) mod parts."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % parts


def words_of(data: bytes | None) -> list[bytes]:
    return (data or b"").translate(LOWER_ASCII).split()


def hashed(words) -> np.ndarray:
    """64-bit hashes that stand for the words, as signed longs."""
    digest = xxhash.xxh3_64_intdigest
    return np.array([digest(w) for w in words], dtype=np.uint64).view(np.int64)


def _word_counts(parts: int, held: int, most: int = 750_000):
    """Counts of the words and ends of training documents, gathered over a task, passed on before they grow past ``most``."""

    def rows(words: Counter):
        h, n = hashed(words), np.fromiter(words.values(), dtype=np.int64, count=len(words))
        for a in range(0, len(h), 200_000):
            yield record_batch({"h": pa.array(h[a : a + 200_000]), "n": pa.array(n[a : a + 200_000])})

    def run(batches):
        words: Counter = Counter()
        for batch in slices(batches, "data", 8 << 20):
            for data, doc_id in zip(batch.column("data"), batch.column("doc_id").to_pylist()):
                if fold(doc_id, parts) != held:
                    words.update(words_of(data.as_py()))
                    words[END] += 1
            if len(words) > most:
                yield from rows(words)
                words = Counter()
        yield from rows(words)

    return run


@dataclass
class Dictionary:
    """Hashes in order, the code of each, and the training counts by code. Codes go from frequent to rare. ``least`` is how often
    training holds every word that isn't here at most."""

    names: np.ndarray
    codes: np.ndarray
    counts: np.ndarray
    least: int

    def code(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.names):
            return np.zeros(len(hashes), dtype=np.int32)
        at = np.minimum(np.searchsorted(self.names, hashes), len(self.names) - 1)
        return np.where(self.names[at] == hashes, self.codes[at], OTHER).astype(np.int32)


def dictionary(words: DataFrame, vocabulary: int, texts: int) -> Dictionary:
    """The most frequent words (h, c) of those that occur twice or more, and the end; the start's count is that of the texts."""
    kept = words.where("c >= 2").orderBy(F.desc("c"), "h").limit(vocabulary).toArrow()  # bounded by the parameter
    h, c = kept.column("h").to_numpy(), kept.column("c").to_numpy()
    at = np.argsort(h)
    full = len(h) == vocabulary
    return Dictionary(h[at], (at + 2).astype(np.int32), np.concatenate([[0, texts], c]).astype(np.int64), int(c[-1]) if full else 1)


class _Numbers(dict):
    """Numbers its keys in order of appearance."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The key of a context a that is followed by the word b."""
    x = (a.view(np.uint64) ^ (b.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xC2B2AE3D27D4EB4F)
    return (x ^ x >> np.uint64(31)).view(np.int64)


@dataclass
class Positions:
    """All symbols of a batch of texts: the code of each, its document, whether it teaches, and the words before it, nearest first;
    OTHER where there is none, or one that isn't in the dictionary, and left of it. names are the hashes of the batch's words,
    number says which each symbol is."""

    w: np.ndarray
    doc: np.ndarray
    taught: np.ndarray
    before: list[np.ndarray]
    sizes: list[int]
    held: np.ndarray
    names: np.ndarray
    number: np.ndarray

    def key(self, length: int, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        """The keys of the contexts of a length at some positions; a key only depends on the words, left to right."""
        key = self.before[length - 1][at].astype(np.int64)
        for b in reversed(self.before[: length - 1]):
            key = _mixed(key, b[at])
        return key


def counted_pairs(keys: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct (key, w) in order, as keys and symbols, with their counts and a place of each key."""
    names, first, which = np.unique(keys, return_index=True, return_inverse=True)
    pair, n = np.unique(which << 32 | w, return_counts=True)
    return names[pair >> 32], (pair & 0xFFFFFFFF).astype(np.int32), n, first[pair >> 32]


def positions(batch: pa.RecordBatch, known: Dictionary, depth: int, parts: int, held: int) -> Positions:
    ids = _Numbers({START: 0, END: 1})
    seq, sizes = array("i"), []
    for data in batch.column("data"):
        words = words_of(data.as_py())
        seq.append(0)
        seq.extend(map(ids.__getitem__, words))
        seq.append(1)
        sizes.append(len(words) + 1)
    out = np.array([fold(i, parts) == held for i in batch.column("doc_id").to_pylist()])
    s, h = np.frombuffer(seq, dtype=np.int32), hashed(ids)
    code = known.code(h)
    code[0] = FIRST
    at = np.flatnonzero(s)
    coded = code[s]
    before, alive = [], np.ones(len(at), dtype=bool)
    for k in range(1, depth + 1):
        b = np.where(alive, coded[np.maximum(at - k, 0)], OTHER)
        before.append(b)
        alive = alive & (b != OTHER) & (b != FIRST)
    doc = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    return Positions(coded[at], doc, ~out[doc], before, sizes, out, h, s[at])


def _packed(fields: list[np.ndarray]) -> bytes:
    """Equally long columns of small numbers, their low bytes first, compressed."""
    raw = b"".join(f.astype("<u4").view(np.uint8).reshape(-1, 4).T[:3].tobytes() for f in fields)
    return pa.compress(raw, codec="zstd", asbytes=True)


def _unpacked(blob: bytes, fields: int, n: int) -> list[np.ndarray]:
    raw = np.frombuffer(pa.decompress(blob, decompressed_size=3 * fields * n, codec="zstd", asbytes=True), dtype=np.uint8).reshape(fields, 3, n)
    return [(x[0].astype(np.int32) | x[1].astype(np.int32) << 8 | x[2].astype(np.int32) << 16) for x in raw]


POSTINGS = "bucket int, base long, n int, blob binary, rid array<long>, doc_id array<long>, n_tokens array<long>, held array<boolean>, base_sum array<double>, known array<int>"
OWN = {"rid": pa.int64(), "doc_id": pa.int64(), "n_tokens": pa.int64(), "held": pa.bool_(), "base_sum": pa.float64(), "known": pa.int32()}


@dataclass
class Hot:
    """Contexts that are dealt out, by length: their keys in order, and of each the size, the count of symbols that aren't kept, and
    whether it is retained."""

    keys: list[np.ndarray] = field(default_factory=list)
    size: list[np.ndarray] = field(default_factory=list)
    once: list[np.ndarray] = field(default_factory=list)
    retained: list[np.ndarray] = field(default_factory=list)

    def which(self, length: int, keys: np.ndarray) -> np.ndarray:
        """The place of each key among the hot contexts of a length, -1 for others."""
        if length > len(self.keys) or not len(self.keys[length - 1]):
            return np.full(len(keys), -1)
        names = self.keys[length - 1]
        at = np.minimum(np.searchsorted(names, keys), len(names) - 1)
        return np.where(names[at] == keys, at, -1)


def _postings(known, hot, buckets: int, hot_buckets: int, depth: int, parts: int, held: int):
    """Per batch of documents a row for each bucket with its positions, and one with what is known of the documents without
    contexts. Buckets from ``buckets`` on hold what is dealt out. A position whose word before isn't in the dictionary has no
    context and stays away."""

    def run(batches):
        words, dealt = known.value, hot.value
        logs = np.log10(words.counts + 1)
        for batch in slices(batches, "data", BATCH):
            p = positions(batch, words, depth, parts, held)
            base, spread = batch.column("rid")[0].as_py(), p.key(1)
            is_hot = dealt.which(1, spread) >= 0
            at = np.flatnonzero(is_hot)
            for k in range(1, depth + 1):  # those whose context of k words is hot
                if not len(at):
                    break
                spread[at] = p.key(k + 1, at) if k < depth else _mixed(p.key(k, at), p.doc[at] + np.int32(base & 0xFFFFFF))
                at = at[dealt.which(k + 1, spread[at]) >= 0] if k < depth else at
            sent = np.flatnonzero(p.before[0] != OTHER)
            number = _mixed(spread[sent], np.full(len(sent), 7)).view(np.uint64)
            bucket = np.where(is_hot[sent], buckets + number % np.uint64(max(hot_buckets, 1)), number % np.uint64(buckets)).astype(np.int32)
            order = np.argsort(bucket.astype(np.uint16) if buckets + hot_buckets < 1 << 16 else bucket, kind="stable")
            bucket, sent = bucket[order], sent[order]
            edges = np.flatnonzero(np.diff(bucket, prepend=-1, append=-1))
            fields = [x[sent] for x in (p.w, p.doc, p.taught, *p.before)]
            rows = []
            for a, b in zip(edges, edges[1:]):
                doc = fields[1][a:b]
                rows.append((bucket[a], b - a, _packed([fields[0][a:b], np.diff(doc, prepend=0), fields[2][a:b], *(x[a:b] for x in fields[3:])])))
            none = lambda n: {c: pa.nulls(n, pa.list_(k)) for c, k in OWN.items()}
            for a in range(0, len(rows), 64):
                number, sizes, blobs = zip(*rows[a : a + 64])
                yield record_batch({"bucket": pa.array(number, pa.int32()), "base": pa.array([base] * len(number)), "n": pa.array(sizes, pa.int32()), "blob": pa.array(blobs, pa.binary())} | none(len(number)))
            n_docs = len(p.sizes)
            unknown = p.w == OTHER
            sure = unknown & p.taught if words.least == 1 else np.zeros(len(unknown), dtype=bool)  # met once, here
            base_sum = np.bincount(p.doc, np.where(sure, np.log10(2), logs[p.w]), minlength=n_docs)
            met = np.bincount(p.doc, ~unknown | sure, minlength=n_docs).astype(np.int32)
            span = np.array([0, n_docs])
            own = {"rid": batch.column("rid"), "doc_id": batch.column("doc_id"), "n_tokens": pa.array(p.sizes, pa.int64()), "held": pa.array(p.held), "base_sum": pa.array(base_sum), "known": pa.array(met)}
            yield record_batch({"bucket": pa.array([base % buckets], pa.int32()), "base": pa.array([base]), "n": pa.array([0], pa.int32()), "blob": pa.nulls(1, pa.binary())} | {c: list_array(x, span) for c, x in own.items()})

    return run


def _others(known, parts: int, held: int):
    """(rid, h) of the words that the dictionary doesn't hold, where it doesn't tell how often training does."""

    def run(batches):
        words = known.value
        for batch in slices(batches, "data", BATCH):
            if words.least == 1:
                batch = batch.filter(pa.array([fold(i, parts) == held for i in batch.column("doc_id").to_pylist()]))
            if batch.num_rows:
                p = positions(batch, words, 1, parts, held)
                at = np.flatnonzero(p.w == OTHER)
                yield record_batch({"rid": pa.array(batch.column("rid").to_numpy()[p.doc[at]]), "h": pa.array(p.names[p.number[at]])})

    return run


class Bucket:
    """The positions of one bucket, of all batches: columns as in Positions, and where each batch's begin and end."""

    def __init__(self, table: pa.Table, depth: int):
        table = table.filter(pc.is_valid(table.column("blob"))).sort_by("base")
        sizes = table.column("n").to_pylist()
        ends = np.cumsum([0, *sizes])
        columns = [np.empty(ends[-1], dtype=np.int32) for _ in range(3 + depth)]
        self.spans = list(zip(table.column("base").to_pylist(), ends.tolist(), ends[1:].tolist()))
        for (_, a, b), blob in zip(self.spans, table.column("blob")):
            for column, part in zip(columns, _unpacked(blob.as_py(), 3 + depth, b - a)):
                column[a:b] = part
            columns[1][a:b] = np.cumsum(columns[1][a:b])
        self.w, self.doc, taught, *self.before = columns
        self.taught = taught.astype(bool)

    def by_word(self) -> Iterator[np.ndarray]:
        """The positions in parts of about SLICE, all those after one word in one part."""
        order = np.argsort(self.before[0], kind="stable").astype(np.int32)
        word = self.before[0][order]
        while len(order):
            end = int(np.searchsorted(word, word[min(SLICE, len(word)) - 1], "right"))
            yield order[:end]
            order, word = order[end:], word[end:]

    def taken(self, at: np.ndarray) -> Bucket:
        part = Bucket.__new__(Bucket)
        part.w, part.taught, part.before = self.w[at], self.taught[at], [x[at] for x in self.before]
        return part


def gains(b: Bucket, words: Dictionary, unit: int, bar: float, hot: Hot, asked: dict[int, tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """What contexts add to each position, as natural logarithms. asked: for a length, the keys and symbols of hot contexts, sorted,
    with their counts in all of training."""
    total = np.zeros(len(b.w))
    log_below = np.log((words.counts + 1) / unit)[b.w]  # only used for kept symbols, which the dictionary holds
    group = key = None
    here = np.arange(len(b.w))
    for length, word in enumerate(b.before, 1):
        here = here[(word[here] != OTHER)]
        if not len(here):
            break
        if length == 1:
            group = word.astype(np.int64)
        else:
            wide = np.zeros(len(b.w), dtype=np.int64)
            wide[here] = np.unique(group[here] << 32 | word[here], return_inverse=True)[1]
            group = wide
        pair, first, which = np.unique(group[here] << 32 | b.w[here], return_index=True, return_inverse=True)
        context, symbol, at = (pair >> 32), pair & 0xFFFFFFFF, here[first]
        context = np.unique(context, return_inverse=True)[1]
        n = np.bincount(which, b.taught[here], minlength=len(pair))
        groups = int(context.max()) + 1
        size = np.bincount(context, n, minlength=groups)
        lead = np.zeros(groups, dtype=np.int64)
        lead[context] = at
        key = word.astype(np.int64)[lead]
        for nearer in reversed(b.before[: length - 1]):
            key = _mixed(key, nearer[lead])
        place = hot.which(length, key)
        special = place[context] >= 0
        if special.any():
            names, counts = asked[length]
            mine = np.stack([key[context[special]], symbol[special]], axis=1).view([("k", np.int64), ("w", np.int64)]).ravel()
            spot = np.minimum(np.searchsorted(names, mine), max(len(names) - 1, 0))
            n[special] = np.where(names[spot] == mine, counts[spot], 0) if len(names) else 0
        kept = (n >= 2) & (symbol != OTHER)
        once = size - np.bincount(context, np.where(kept, n, 0), minlength=groups)
        is_hot = place >= 0
        if is_hot.any():
            size, once = np.where(is_hot, hot.size[length - 1][place], size), np.where(is_hot, hot.once[length - 1][place], once)
        below = np.exp(log_below[at])
        left = (once + 1) / (size + 1)
        ratio = np.where(kept, np.log((n + (once[context] + 1) * below) / (size[context] + 1) / below), np.log(left)[context])
        cost = bar * np.bincount(context, kept, minlength=groups)
        retained = (np.bincount(context, n * ratio, minlength=groups) > cost) & (cost > 0)
        if is_hot.any():
            retained = np.where(is_hot, hot.retained[length - 1][place], retained)
        ratio = np.where(retained[context], ratio, 0.0)[which]
        total[here] += ratio
        log_below[here] += ratio
        here = here[(size >= 2)[context][which]]  # a longer context than one met once keeps nothing
    return total


GAINS = "base long, at array<int>, gain array<double>, rid array<long>, doc_id array<long>, n_tokens array<long>, held array<boolean>, base_sum array<double>, known array<int>"


def _gain_rows(base: list[int], at: list[np.ndarray], gain: list[np.ndarray]) -> pa.RecordBatch:
    places = np.cumsum([0, *map(len, at)])
    none = {c: pa.nulls(len(base), pa.list_(k)) for c, k in OWN.items()}
    joined = lambda x, kind: np.concatenate([np.empty(0), *x]).astype(kind)
    return record_batch({"base": pa.array(base, pa.int64()), "at": list_array(pa.array(joined(at, np.int32)), places), "gain": list_array(pa.array(joined(gain, np.float64)), places)} | none)


def _scores(known, hot, buckets: int, unit: int, bar: float, depth: int):
    """A bucket's positions, and the counts it asked for, to what contexts add to each document; documents' own rows pass."""

    def scored(table: pa.Table, values: pa.Table | None) -> pa.Table:
        own = table.filter(pc.is_valid(table.column("rid"))).select(["base", *OWN])
        out = [pa.table({"base": own.column("base"), "at": pa.nulls(len(own), pa.list_(pa.int32())), "gain": pa.nulls(len(own), pa.list_(pa.float64()))} | {c: own.column(c) for c in OWN})]
        b = Bucket(table, depth)
        if len(b.w):
            asked, dealt = {}, values is not None and table.column("bucket")[0].as_py() >= buckets
            for length in range(1, depth + 1) if dealt else ():
                mine = values.filter(pc.equal(values.column("length"), length))
                k, w, n = (mine.column(c).to_numpy() for c in ("key", "w", "n"))
                order = np.lexsort((w, k))
                asked[length] = (np.stack([k[order], w[order].astype(np.int64)], axis=1).view([("k", np.int64), ("w", np.int64)]).ravel(), n[order])
            gain = np.zeros(len(b.w))
            for at in b.by_word():
                gain[at] = gains(b.taken(at), known.value, unit, bar, hot.value if dealt else Hot(), asked)
            found = [(base, np.bincount(b.doc[a:e], gain[a:e])) for base, a, e in b.spans]
            at = [np.flatnonzero(x) for _, x in found]
            out.append(pa.Table.from_batches([_gain_rows([base for base, _ in found], at, [x[i] for (_, x), i in zip(found, at)])]))
            del b, gain
            give_back()
        return pa.concat_tables(out)

    return scored


def _requests(hot, buckets: int, depth: int):
    """(bucket, length, key, w): the symbols of hot contexts that a bucket meets."""

    def run(table: pa.Table) -> pa.Table:
        if table.column("bucket")[0].as_py() < buckets:
            return pa.table({"bucket": pa.array([], pa.int32()), "length": pa.array([], pa.int32()), "key": pa.array([], pa.int64()), "w": pa.array([], pa.int32())})
        b, dealt, out = Bucket(table, depth), hot.value, []
        p = Positions(b.w, b.doc, b.taught, b.before, [], b.doc, b.w, b.w)
        at = np.arange(len(b.w))
        for length in range(1, depth + 1):  # what begins a hot context is hot, and so is what ends it
            at = at[b.before[length - 1][at] != OTHER]
            key = p.key(length, at)
            at, key = at[mine := dealt.which(length, key) >= 0], key[mine]
            key, w, _, _ = counted_pairs(key, b.w[at])
            out.append(pa.table({"length": pa.array(np.full(len(key), length, dtype=np.int32)), "key": pa.array(key), "w": pa.array(w)}))
        found = pa.concat_tables(out)
        return found.add_column(0, "bucket", pa.array(np.full(len(found), table.column("bucket")[0].as_py(), dtype=np.int32)))

    return run


def _task_sums(most: int = 32 << 20):
    """Adds up what a task's buckets give for a batch of documents, so that less is shuffled where a task has several buckets; passed
    on before it takes ``most`` bytes. Documents' own rows pass as they are."""

    def run(batches):
        sums: dict[int, np.ndarray] = {}

        def rows():
            at = [np.flatnonzero(x) for x in sums.values()]
            if sums:
                yield _gain_rows(list(sums), at, [x[i] for x, i in zip(sums.values(), at)])

        for batch in batches:
            own = batch.filter(pc.is_valid(batch.column("rid")))
            if own.num_rows:
                yield own
            batch = batch.filter(pc.is_null(batch.column("rid")))
            for i, base in enumerate(batch.column("base").to_pylist()):
                at, gain = (batch.column(c)[i].values.to_numpy() for c in ("at", "gain"))
                if len(at):
                    old = sums.get(base, np.empty(0))
                    if len(old) <= at[-1]:
                        old = np.concatenate([old, np.zeros(at[-1] + 1 - len(old))])
                    old[at] += gain
                    sums[base] = old
            if sum(x.nbytes for x in sums.values()) > most:
                yield from rows()
                sums = {}
        yield from rows()

    return run


def _totals(batches):
    """Rows sorted by batch of documents: adds up what contexts give, and gives a row a document."""
    base, own, gain = None, None, np.zeros(0)

    def rows():
        return record_batch(own | {"gain": pa.array(np.concatenate([gain, np.zeros(len(own["rid"]) - len(gain))]))})

    for batch in batches:
        for i, now in enumerate(batch.column("base").to_pylist()):
            if now != base:
                if base is not None:
                    yield rows()
                base, own, gain = now, None, np.zeros(0)
            if batch.column("rid")[i].is_valid:
                own = {c: batch.column(c)[i].values for c in OWN}
                continue
            at = batch.column("at")[i].values.to_numpy()
            if len(at):
                if len(gain) <= at[-1]:
                    gain = np.concatenate([gain, np.zeros(at[-1] + 1 - len(gain))])
                gain[at] += batch.column("gain")[i].values.to_numpy()
    if base is not None:
        yield rows()


def _gathered(known, hot, length: int, parts: int, held: int):
    """(key, suffix, w, n, c): counts of the symbols after hot contexts of one length, per batch of training documents; c is
    the count of the symbol in all of training."""

    def run(batches):
        for batch in slices(batches, "data", BATCH):
            p = positions(batch, known.value, length, parts, held)
            at = np.flatnonzero(p.taught & (p.before[length - 1] != OTHER))
            key = p.key(length, at)
            at, key = at[mine := hot.value.which(length, key) >= 0], key[mine]
            shorter = p.key(length - 1, at) if length > 1 else np.zeros(len(at), dtype=np.int64)
            key, w, n, first = counted_pairs(key, p.w[at])
            yield record_batch({"key": pa.array(key), "suffix": pa.array(shorter[first]), "w": pa.array(w), "n": pa.array(n), "c": pa.array(known.value.counts[w])})

    return run


def _hot_contexts(picked: DataFrame, known, words: Dictionary, unit: int, bar: float, bound: int, depth: int, parts: int, held: int) -> tuple[Hot, DataFrame | None]:
    """The contexts that occur ``bound`` times or more, and a table (length, key, w, n, log) of the symbols after them, log their
    logarithm of probability. A hot context's suffix and its beginning are hot, so each length is found in the one before."""
    spark, hot, tables = picked.sparkSession, Hot(), []
    codes = np.flatnonzero(words.counts >= bound).astype(np.int64)
    keys = np.sort(codes[codes != OTHER])
    for length in range(1, depth + 1):
        if not len(keys):
            break
        hot.keys.append(keys)
        found = map_arrow(picked, _gathered(known, spark.sparkContext.broadcast(hot), length, parts, held), "key long, suffix long, w int, n long, c long")
        found = stored(found.groupBy("key", "suffix", "w").agg(F.sum("n").alias("n"), F.max("c").alias("c")), "gathered")
        kept = (F.col("n") >= 2) & (F.col("w") != OTHER)
        stats = found.groupBy("key").agg(F.sum("n").alias("size"), F.sum(F.when(kept, 0).otherwise(F.col("n"))).alias("once"))
        if length == 1:
            below = found.withColumn("below", (F.col("c") + 1) / unit)
        else:
            below = found.join(tables[-1].select(F.col("key").alias("suffix"), "w", F.col("p").alias("below")), ["suffix", "w"], "left")
        left = (F.col("once") + 1) / (F.col("size") + 1)
        p = F.when(kept, (F.col("n") + (F.col("once") + 1) * F.col("below")) / (F.col("size") + 1))
        ratio = F.when(kept, F.log(p / F.col("below"))).otherwise(F.log(left))
        each = below.join(stats, "key").withColumns({"p": p, "ratio": ratio})
        earned = each.groupBy("key", "size", "once").agg(F.sum(F.col("n") * F.col("ratio")).alias("gain"), F.sum(kept.cast("long")).alias("kept"))
        rows = sorted(earned.collect(), key=lambda r: r["key"])  # a row for each hot context
        retained = [bool(r["kept"] > 0 and r["gain"] > bar * r["kept"]) for r in rows]
        for name, values in (("size", [r["size"] for r in rows]), ("once", [r["once"] for r in rows]), ("retained", retained)):
            getattr(hot, name).append(np.array(values))
        hot.keys[-1] = np.array([r["key"] for r in rows], dtype=np.int64)
        good = spark.createDataFrame(pa.table({"key": pa.array(hot.keys[-1]), "good": pa.array(retained, pa.bool_())}))
        stands = F.when(F.col("good"), F.col("p")).otherwise(F.col("below"))
        tables.append(stored(each.join(good, "key").where(kept).select(F.lit(length).alias("length"), "key", "w", "n", stands.alias("p")), "hot"))
        if length < depth:
            longer = found.where((F.col("n") >= bound) & (F.col("w") != OTHER)).select("key", "w").distinct().toArrow()
            keys = np.sort(_mixed(longer.column("key").to_numpy().copy(), longer.column("w").to_numpy()))
    if not tables:
        return hot, None
    every = tables[0]
    for more in tables[1:]:
        every = every.unionAll(more)
    return hot, every


def score_documents(docs: DataFrame, *, parts: int = 7, held: int = 2, cost: float = 0.3, depth: int = 3, vocabulary: int = VOCABULARY, bucket: int = BUCKET, hot: int = HOT, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for each row of docs.

    Texts are scored by what the rows with crc32(doc_id) mod parts other than ``held`` teach. Null texts are empty: one
    token, the end. Null ids count as an empty id, so they train. Repeated rows are scored and counted apart; other
    columns are ignored; an empty table gives no rows; with nothing to train on nothing is known. Words are told apart by
    64-bit hashes. ``cost`` is what a kept symbol has to earn, in
    units of half the logarithm of the training tokens, ``depth`` the most words of a context. ``vocabulary`` bounds the
    dictionary; the base doesn't depend on it. ``bucket`` and ``hot`` only say where the work is done: results don't
    depend on them.
    """
    broadcast = docs.sparkSession.sparkContext.broadcast
    picked = with_row_id(docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("binary").alias("data")), "doc_id", "data")
    words = stored(map_arrow(picked, _word_counts(parts, held), "h long, n long").groupBy("h").agg(F.sum("n").alias("c")), "words")
    end = int(hashed([END])[0])
    total, kinds, ends = (int(x or 0) for x in words.agg(F.sum("c"), F.count("*"), F.max(F.when(F.col("h") == end, F.col("c")))).first())
    unit, bar = total + kinds + 1, cost * 0.5 * float(np.log(max(total, 2)))
    own = dictionary(words, vocabulary, ends)
    known = broadcast(own)
    contexts, gathered = _hot_contexts(picked, known, own, unit, bar, max(hot, total // MOST_HOT), depth, parts, held)
    dealt = broadcast(contexts)
    common = int(own.counts[contexts.keys[0]].sum()) if contexts.keys else 0
    buckets, hot_buckets = max(1, -(-(total - common) // bucket)), -(-common // bucket)
    postings = map_arrow(picked, _postings(known, dealt, buckets, hot_buckets, depth, parts, held), POSTINGS).groupBy("bucket")
    score = _scores(known, dealt, buckets, unit, bar, depth)
    if gathered is None:
        sums = postings.applyInArrow(lambda table: score(table, None), GAINS)
    else:
        asked = postings.applyInArrow(_requests(dealt, buckets, depth), "bucket int, length int, key long, w int")
        answers = asked.join(gathered.drop("p"), ["length", "key", "w"]).select("bucket", "length", "key", "w", "n")
        sums = postings.cogroup(answers.groupBy("bucket")).applyInArrow(score, GAINS)
    each = map_arrow(map_arrow(sums, _task_sums(), GAINS).repartition("base").sortWithinPartitions("base"), _totals, "rid long, doc_id long, n_tokens long, held boolean, base_sum double, known int, gain double")
    others = map_arrow(picked, _others(known, parts, held), "rid long, h long").join(words, "h").groupBy("rid").agg(F.sum(F.log10(F.col("c") + 1)).alias("more"), F.count("*").alias("met"))
    each = each.join(others, "rid", "left").fillna(0, ["more", "met"])
    n = F.col("n_tokens")
    base = F.col("base_sum") + F.col("more") - n * float(np.log10(unit))
    return each.select(
        "doc_id",
        F.col("held").alias("held_out"),
        "n_tokens",
        (F.col("known") + F.col("met")).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        base.alias("base_score"),
        (base + F.col("gain") / float(np.log(10))).alias("score"),
    )
