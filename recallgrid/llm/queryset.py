"""Stated sets of short texts (benchmark items) that are held against all documents, a bounded block at a time."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Word bytes: digits, a-z and everything past ASCII; A-Z are lower-cased, all else parts words.
WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Stands between the texts of a batch; no word holds it.
MARK = b"\x01"


def words_of(text: str | None) -> list[bytes]:
    """The words of a text, A-Z lower-cased; none for null."""
    return (text or "").encode().translate(WORDS).split()


def batch_words(texts: list[str], piece: int = 8 << 20) -> Iterator[list[bytes]]:
    """The words of many texts in pieces of about ``piece`` bytes, a MARK after each text. Pieces end between words."""
    held, size = [], 0
    for text in texts:
        data = text.encode().translate(WORDS)
        while len(data) > piece and (cut := data.find(b" ", piece)) >= 0:  # a very long text is cut at a space
            yield b" ".join([*held, data[:cut]]).split()
            held, size, data = [], 0, data[cut:]
        held += [data, MARK]
        size += len(data) + 4
        if size > piece:
            yield b" ".join(held).split()
            held, size = [], 0
    if held:
        yield b" ".join(held).split()


def item_blocks(items: DataFrame, most: int, *, id_column: str = "item_id", text_column: str = "text") -> Iterator[list[tuple[int | None, list[str]]]]:
    """Blocks of (item id, its texts) of about ``most`` bytes, at most twice that unless one item alone is larger.

    Rows of one id are one item; repeated rows count once, null texts have no words; a null id is an item of its own.
    Items are dealt by a hash of their id; sizes are summed before anything is fetched, so what the driver holds and
    broadcasts at a time is bounded whatever the number of items.
    """
    rows = items.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text")).where("text IS NOT NULL").distinct()
    sizes = rows.groupBy("id").agg(F.sum(F.octet_length("text") + 16).alias("n"))
    total, largest, number = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0)), F.count("*")).first()
    parts, dealt = max(1, -(-total // most)), F.xxhash64("id")
    while parts > 1 and parts < 4 * number:
        fullest = sizes.groupBy(F.pmod(dealt, F.lit(parts)).alias("p")).agg(F.sum("n").alias("n")).agg(F.max("n")).first()[0]
        if fullest <= max(2 * most, largest):
            break
        parts *= 2
    for part in range(parts):
        found: dict[int | None, list[str]] = {}
        for r in rows.where(F.pmod(dealt, F.lit(parts)) == part).orderBy("id", "text").collect():
            found.setdefault(r["id"], []).append(r["text"])
        if found or parts == 1:
            yield list(found.items())
