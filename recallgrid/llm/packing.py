"""Operator 6: documents packed into as few sequences as possible.

Lengths are at most the capacity, so the whole instance is a histogram of ``capacity`` counts. On it, Martello and
Toth's dominance criterion fixes document sets that some optimal packing has: a length alone, or with one partner,
where every other set that could hold it fits inside. What is left is packed best fit, longest first, all pieces of
one length in one step. The plan says which ranks of a length go to which sequences; the pieces look their place up.
"""

from __future__ import annotations

import functools
import json
import string
import struct
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .bpe import byte_characters, serialise
from .common import map_arrow, record_batch, slices, stored, texts

#: Entries that a worker's memos of chunks and of words may hold before they are emptied.
MOST_CHUNKS, MOST_WORDS = 800_000, 500_000


@functools.cache
def _tokenizer(path: str) -> Tokenizer:
    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


class WordBpe:
    """Ids of a lower-casing BPE with word ends, equal to the library's, from a memo of the chunks between spaces.

    White space is dropped by this tokenizer and no token reaches over it, so chunks can be encoded apart. New chunks in
    Latin-1 are cut by the file's own pattern and merged by a sentencepiece model written from the file: a word's last
    byte joins the end mark first, then merges go by their place in the file. Other chunks, and whole texts that hold a
    special string, go to the library.
    """

    END = "\ue000"

    def __init__(self, path: str):
        self.t = _tokenizer(path)
        with open(path) as file:
            spec = json.load(file)
        suffix = spec["model"]["end_of_word_suffix"]
        place = {"".join(m.split(" ") if isinstance(m, str) else m): i for i, m in enumerate(spec["model"]["merges"])}
        by_id = {i: token for token, i in spec["model"]["vocab"].items()}
        self.special = [x["content"] for x in spec["added_tokens"]]
        plain = [by_id[i] for i in range(len(by_id)) if by_id[i] not in self.special]
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialise([(x.removesuffix(suffix) + self.END if x.endswith(suffix) else x, -1.0 - place[x] if x in place else 0.0) for x in plain]))
        self.pattern = regex.compile(next(x for x in spec["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split")["pattern"]["Regex"])
        self.byte_to_char = dict(enumerate(byte_characters()))
        self.memo: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        return np.array(self.t.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _parts(self, chunk: str) -> list[str]:
        """The pattern's parts of a lower-cased chunk. Letters alone are one part, and so is one mark behind them."""
        if chunk.isalpha():
            return [chunk]
        if chunk[:-1].isalpha() and chunk[-1] in string.punctuation:
            return [chunk[:-1], chunk[-1]]
        return self.pattern.findall(chunk)

    def _learn(self, new: set[str]) -> None:
        memo, words = self.memo, self.words
        cut = {}
        for chunk in new:
            if not chunk.isascii():
                try:
                    chunk.encode("latin-1")
                except UnicodeEncodeError:
                    memo[chunk] = self.whole(chunk)
                    continue
            cut[chunk] = self._parts(chunk.lower())
        met = list(set().union(*cut.values()).difference(words))
        spelled = [(w if w.isascii() and w.isprintable() else w.encode().decode("latin-1").translate(self.byte_to_char)) + self.END for w in met]
        ids = self.model.encode(spelled, num_threads=1) if met else []
        words.update(zip(met, [struct.pack(f"<{len(x)}I", *x) for x in ids]))
        for chunk, parts in cut.items():
            memo[chunk] = words[parts[0]] if len(parts) == 1 else b"".join([words[w] for w in parts])

    def encode_all(self, rows: list[str]) -> list[bytes]:
        split = [None if any(s in text for s in self.special) else text.replace("\n", " ").split(" ") for text in rows]
        self._learn(set().union(*filter(None, split)).difference(self.memo))
        out = [self.whole(text) if chunks is None else b"".join(map(self.memo.__getitem__, chunks)) for text, chunks in zip(rows, split)]
        for known, most in ((self.memo, MOST_CHUNKS), (self.words, MOST_WORDS)):  # memos; what is forgotten is worked out again
            if len(known) > most:
                known.clear()
        return out

    def forget(self) -> None:
        self.memo.clear()
        self.words.clear()


@functools.cache
def word_bpe(path: str) -> WordBpe:
    return WordBpe(path)


def cut_pieces(docs: DataFrame, path: str, *, capacity: int = 2048, separator: int = 0, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, part): each document's ids and the separator, cut where longer than capacity."""

    def run(batches):
        codec, end = word_bpe(path), np.array([separator], dtype="<u4").tobytes()
        for batch in slices(batches, most=4 << 20):
            own, piece, start, length, crc = [], [], [], [], []
            for row, ids in enumerate(codec.encode_all(texts(batch))):
                data = memoryview(ids + end)
                for i, a in enumerate(range(0, len(data), 4 * capacity)):
                    one = data[a : a + 4 * capacity]
                    own.append(row), piece.append(i), start.append(a // 4), length.append(len(one) // 4), crc.append(zlib.crc32(one))
            yield record_batch({"doc_id": batch.column("doc_id").take(pa.array(own)), "piece": pa.array(piece, pa.int32()), "start": pa.array(start, pa.int64()), "length": pa.array(length, pa.int64()), "ids_crc32": pa.array(crc, pa.int64()), "part": batch.column("part").take(pa.array(own))})
        codec.forget()  # a worker that goes on with other work keeps no memo

    picked = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"), F.spark_partition_id().alias("part"))
    return map_arrow(picked, run, "doc_id long, piece int, start long, length long, ids_crc32 long, part int")


class Plan:
    """Placements (length, first rank, last rank, first sequence, offset): rank r of a length goes to sequence first + r - first rank."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.capacity = capacity
        self.left = {n: c for n, c in sorted(counts.items()) if c > 0}
        self.given: dict[int, int] = defaultdict(int)
        self.rows: list[tuple[int, int, int, int, int]] = []
        self.sequences = self.fixed = 0
        self._reduce()
        self._best_fit()

    def _take(self, length: int, n: int, sequence: int, offset: int) -> None:
        first = self.given[length]
        self.rows.append((length, first, first + n - 1, sequence, offset))
        self.given[length] += n
        self.left[length] -= n
        if not self.left[length]:
            del self.left[length]

    def _fix(self, lengths: list[int], n: int) -> None:
        offset = 0
        for length in lengths:
            self._take(length, n, self.sequences, offset)
            offset += length
        self.sequences += n
        self.fixed += n

    def _sums(self) -> int:
        """Bit s is set if pieces of the lengths left may add up to s; counts are ignored, so some bits may be set in excess."""
        bits, mask = 1, (1 << self.capacity + 1) - 1
        for length in self.left:
            step = length
            while step <= self.capacity:
                bits |= bits << step & mask
                step *= 2
        return bits

    def _reduce(self) -> None:
        """Fixes {j} where no piece fits beside j, and {j, y} where y is the longest that fits and no other set beside j
        adds up to more than y: all of it could stand in y's place. Repeated until nothing changes."""
        changed = True
        while changed:
            changed, sums = False, self._sums()
            for j in sorted(self.left, reverse=True):
                if j not in self.left:
                    continue
                room = self.capacity - j
                fit = [n for n in self.left if n <= room and (n != j or self.left[j] > 1)]
                if not fit:
                    self._fix([j], self.left[j])
                    changed = True
                    continue
                y = max(fit)
                if y < room and sums >> y + 1 & (1 << room - y) - 1:
                    continue
                n = self.left[j] // 2 if y == j else min(self.left[j], self.left[y])
                self._fix([j, y], n)
                changed = True

    def _best_fit(self) -> None:
        """Longest first, each to the fullest sequence that has room; sequences with the same room are handled together."""
        rooms: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for length in sorted(self.left, reverse=True):
            while length in self.left:
                room = min((r for r in rooms if r >= length), default=None)
                if room is None:
                    n = -(-self.left[length] // (self.capacity // length))
                    rooms[self.capacity] = [(self.sequences, n)]
                    self.sequences += n
                    room = self.capacity
                while room in rooms and length in self.left:
                    first, n = rooms[room].pop()
                    if not rooms[room]:
                        del rooms[room]
                    used = min(n, self.left[length])
                    self._take(length, used, first, self.capacity - room)
                    if used < n:
                        rooms[room].append((first + used, n - used))
                    if room > length:
                        rooms[room - length].append((first, used))
                    if room - length >= length:
                        break


def pack_pieces(pieces: DataFrame, *, capacity: int = 2048) -> DataFrame:
    """pieces with sequence_id and offset. pieces must be stored: it is read for the histogram and again for the places.

    A piece's rank among those of its length is the count in earlier parts plus its place in its own part; parts are
    bounded, so no window holds more than one part's pieces, however frequent a length is.
    """
    per_part = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in per_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most capacity rows
    plan = Plan(histogram, capacity)
    rows = np.array(sorted(plan.rows) or np.empty((0, 5)), dtype=np.int64).reshape(-1, 5)
    before = per_part.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))
    inside = F.row_number().over(Window.partitionBy("length", "part").orderBy("doc_id", "piece", "ids_crc32")) - 1
    ranked = pieces.withColumn("inside", inside).join(before.drop("n"), ["length", "part"]).withColumn("rank", F.coalesce("before", F.lit(0)) + F.col("inside"))
    placements = pieces.sparkSession.sparkContext.broadcast(rows)  # at most a few placements per length

    def run(batches):
        table = placements.value
        keys = table[:, 0] << 44 | table[:, 1]
        for batch in batches:
            rank = batch.column("rank").to_numpy()
            at = np.searchsorted(keys, batch.column("length").to_numpy() << 44 | rank, side="right") - 1
            fields = {c: batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")}
            yield record_batch(fields | {"sequence_id": pa.array(table[at, 3] + rank - table[at, 1]), "offset": pa.array(table[at, 4])})

    columns = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", F.col("rank").cast("long").alias("rank"))
    return map_arrow(columns, run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack_documents(docs: DataFrame, path: str, *, capacity: int = 2048, separator: int = 0, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null and empty texts are a piece of the separator alone; repeated rows are packed apart; a null id stays null; other
    columns are ignored; an empty table gives no rows. Pieces are stored once, so texts are tokenised once.
    """
    pieces = stored(cut_pieces(docs, path, capacity=capacity, separator=separator, id_column=id_column, text_column=text_column), "pieces")
    return pack_pieces(pieces, capacity=capacity)
