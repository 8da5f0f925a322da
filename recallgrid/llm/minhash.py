"""Operator 10: document fingerprints by one-permutation MinHash, in DataFrame functions only.

Each shingle of words is hashed once; the top bits of the hash name its bin, a bin keeps its least hash. An empty bin
takes the value of the first filled bin in a fixed pseudo-random order of all bins that depends on the empty bin alone
(optimal densification). A fingerprint holds the lowest BITS bits of each bin as one hexadecimal digit; likeness is
the share of equal digits, less the share that equal by chance.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BINS, BITS = 256, 4
#: Bins tried one by one before the rest of the order is searched through the filled bins.
TRIES = 16

_EMPTY = (1 << 56) - 1  # the low 56 bits of a bin's last possible hash mark an empty bin


#: Bin i is filled from bins first + a * step mod BINS for a = 0, 1, ...; step is odd, so the order meets all bins.
FIRST, STEP = (167, 13), (178, 115)  # each times i, plus


def _let(value: Column, body) -> Column:
    """body(value) with value computed once: it becomes the variable of a one-element transform."""
    return F.transform(F.array(value), body)[0]


def least_per_bin(text: Column, words: int) -> Column:
    """array<bigint> of BINS: the least hash of each bin, or the bin's marker where it has none."""
    split = F.split(F.btrim(text, F.lit(" \t\n\x0b\f\r")), "[\\x20\\x09-\\x0D]+")
    markers = F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda b: F.shiftleft(b.cast("long"), 56).bitwiseOR(F.lit(_EMPTY)))
    hashes = lambda w: F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - words, F.lit(0))), lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(words))))
    return _let(split, lambda w: _let(F.sort_array(F.concat(hashes(w), markers)), lambda s: F.filter(s, lambda x, i: (i == 0) | (F.shiftright(x, 56) != F.shiftright(F.get(s, i - 1), 56)))))


def densified(least: Column) -> Column:
    """The array with every empty bin filled from another; any text has at least one shingle, so some bin is filled.
    A borrowed value is hashed with its new bin: else few shingles would give the same digit many times."""
    empty = lambda x: x.bitwiseAND(F.lit(_EMPTY)) == _EMPTY

    def tried(own: Column) -> Column:
        def one(x, i):
            at = lambda a: (i * (FIRST[0] + STEP[0] * a) + (FIRST[1] + STEP[1] * a)).bitwiseAND(F.lit(BINS - 1))
            found = F.coalesce(*(F.get(own, at(a)) for a in range(TRIES)))
            return F.when(x.isNotNull(), x).otherwise(_let(found, lambda v: F.when(v.isNotNull(), F.xxhash64(v, i))))

        return F.transform(own, one)

    def searched(own: Column, after: Column) -> Column:
        """Where the tries met only empty bins: the filled bin that comes first in the order, by the step's inverse."""
        places = F.filter(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda j: F.get(own, j).isNotNull())
        inverses = F.array(*(F.lit(pow(STEP[0] * i + STEP[1], -1, BINS)) for i in range(BINS)))

        def one(x, i, places):
            first, inverse = i * FIRST[0] + FIRST[1], F.get(inverses, i)
            best = _let(F.struct(first.alias("f"), inverse.alias("v")), lambda c: F.array_min(F.transform(places, lambda j: ((j - c["f"]) * c["v"]).bitwiseAND(F.lit(BINS - 1)) * BINS + j)))
            return F.when(x.isNotNull(), x).otherwise(F.xxhash64(F.get(own, best.bitwiseAND(F.lit(BINS - 1))), i))

        return _let(places, lambda p: F.transform(after, lambda x, i: one(x, i, p)))

    def filled(own: Column) -> Column:
        return _let(tried(own), lambda t: F.when(F.exists(t, lambda x: x.isNull()), searched(own, t)).otherwise(t))

    return F.when(F.exists(least, empty), _let(F.transform(least, lambda x: F.when(~empty(x), x)), filled)).otherwise(least)


def packed(bins: Column) -> Column:
    """array<bigint>: the low BITS bits of the bins, 16 bins to a long, first bin highest."""
    per = 64 // BITS
    low = (1 << BITS) - 1
    return F.transform(
        F.sequence(F.lit(0), F.lit(BINS // per - 1)),
        lambda k: F.aggregate(F.slice(bins, k * per + 1, per), F.lit(0).cast("long"), lambda a, x: F.shiftleft(a, BITS).bitwiseOR(x.bitwiseAND(F.lit(low)))),
    )


def fingerprint(text: Column, words: int = 5) -> Column:
    """The packed fingerprint of a text (null: empty).
    A text with fewer words has one shingle, one without words an empty one.
    """
    return _let(_let(least_per_bin(F.coalesce(text, F.lit("")), words), densified), packed)


def digits(bits: Column) -> Column:
    return F.array_join(F.transform(bits, lambda x: F.lower(F.lpad(F.hex(x), 16, "0"))), "")


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity, 0 to 1: equal bins beyond the 1 in 2^BITS that equal by chance."""
    ones = int("1" * 16, 16)

    def unequal(x, y):
        d = x.bitwiseXOR(y)
        for shift in (2, 1):
            d = d.bitwiseOR(F.shiftrightunsigned(d, shift))
        return F.bit_count(d.bitwiseAND(F.lit(ones)))

    differ = F.aggregate(F.zip_with(a, b, unequal), F.lit(0), lambda n, x: n + x)
    chance = 1 / (1 << BITS)
    return F.greatest(F.lit(0.0), (1 - differ / BINS - chance) / (1 - chance))


def with_next(docs: DataFrame, *, words: int = 5, per_bucket: int = 4096, most_buckets: int = 10_000) -> DataFrame:
    """Rows (doc_id, text, print) with those of the next row in descending doc_id (null last, then by text); the first
    row follows the last. Rows are cut into buckets by doc_id, so that no window holds more than a bucket; only a
    bucket's first row, with a print of its own, goes to the bucket before it and stands there at the end."""
    ids = docs.where("doc_id IS NOT NULL").select("doc_id")
    count = ids.count()
    n = max(1, min(most_buckets, -(-count // per_bucket)))
    cuts = sorted(set(ids.select(F.percentile_approx("doc_id", [i / n for i in range(1, n)] or [0.5], 20 * n)).first()[0] or []))[: n - 1] if count else []
    bucket = F.when(F.col("doc_id").isNull(), F.lit(len(cuts) + 1)).otherwise(F.lit(len(cuts)) - _below(cuts)).cast("int")
    firsts = docs.select("doc_id", "text").withColumn("bucket", bucket).groupBy("bucket").agg(F.min(F.struct(F.bitwise_not("doc_id").alias("o"), "text")).alias("head"))
    firsts = firsts.select("bucket", F.col("head.text").alias("text")).withColumn("print", fingerprint(F.col("text"), words))  # as many as buckets
    following = Window.orderBy("bucket")  # bucket numbers alone
    before = F.coalesce(F.lag("bucket").over(following), F.max("bucket").over(following.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    numbers = docs.select(bucket.alias("bucket")).distinct().withColumn("before", before)
    heads = firsts.join(F.broadcast(numbers), "bucket").select(F.lit(None).cast("long").alias("doc_id"), "text", "print", F.col("before").alias("bucket"), F.lit(True).alias("head"))
    dealt = docs.select("doc_id", "text", "print", bucket.alias("bucket"), F.lit(False).alias("head")).union(heads)
    window = Window.partitionBy("bucket").orderBy("head", F.col("doc_id").desc_nulls_last(), "text")
    nexts = (F.lead(c).over(window).alias(f"next_{c}") for c in ("text", "print"))
    return dealt.select("doc_id", "text", "print", "head", *nexts).where(~F.col("head")).drop("head")


def _below(cuts: list[int]) -> Column:
    """How many of the sorted cuts are below doc_id, by halving. The steps are a fold, so the expression stays as short for many cuts."""
    if not cuts:
        return F.lit(0)
    array = F.split(F.lit(",".join(map(str, cuts))), ",").cast("array<bigint>")  # folded to one literal
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(len(cuts).bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda place, step: F.when((place + step <= len(cuts)) & (F.get(array, place + step - 1) < F.col("doc_id")), place + step).otherwise(place))


def edited_pairs(docs: DataFrame, *, words: int = 5, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, n_chars, edited, fingerprint, edited_fingerprint, near_edited, near_next) for each row of docs.

    The edited text has the last third of the code points replaced by the first as many (or all) of the next document,
    in descending doc_id, null last; the first follows the last, so a single document follows itself. Null texts are
    empty, and empty texts are alike. Repeated rows are each other's next; other columns are ignored; an empty table
    gives no rows.
    """
    base = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    pairs = with_next(base.withColumn("print", fingerprint(F.col("text"), words)), words=words)
    n = F.char_length("text")
    cut = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - cut), F.substring("next_text", F.lit(1), cut))
    pairs = pairs.select("doc_id", n.cast("long").alias("n_chars"), edited.alias("edited"), "print", "next_print")
    pairs = pairs.withColumn("edited_print", fingerprint(F.col("edited"), words))
    return pairs.select(
        "doc_id", "n_chars", "edited",
        F.col("print").alias("fingerprint"),
        F.col("edited_print").alias("edited_fingerprint"),
        likeness(F.col("print"), F.col("edited_print")).alias("near_edited"),
        likeness(F.col("print"), F.col("next_print")).alias("near_next"),
    )
