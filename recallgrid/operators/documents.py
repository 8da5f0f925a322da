"""Structure of texts: blocks, heading paths, code symbols, chunks."""

from __future__ import annotations

import hashlib
import re

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx

SYMBOL = r"^\s*(?:export\s+)?(?:async\s+)?(?:function|class|interface|type|enum|def|const)\s+([A-Za-z_$][\w$]*)"


def lines(docs: DataFrame) -> DataFrame:
    """(doc_id, no, line): the lines of each text, numbered from 0."""
    return docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("no", "line"))


def markdown_blocks(docs: DataFrame) -> DataFrame:
    """(doc_id, block, kind, level, text): fenced code, headings and paragraphs parted by blank lines.

    A fence toggles code; a heading is a block; a blank line outside code ends a paragraph. Windows hold one document.
    """
    order = Window.partitionBy("doc_id").orderBy("no")
    l = lines(docs).withColumn("fence", F.col("line").rlike("^\\s*```"))
    l = l.withColumn("fences", F.sum(F.col("fence").cast("int")).over(order))
    l = l.withColumn("code", (F.col("fences") % 2 == 1) | F.col("fence"))
    l = l.withColumn("level", F.when(~F.col("code"), F.length(F.nullif(F.regexp_extract("line", r"^(#{1,6})\s+\S", 1), F.lit("")))))
    l = l.withColumn("blank", ~F.col("code") & (F.btrim("line") == ""))
    before = lambda c: F.lag(c).over(order)
    starts = F.col("level").isNotNull() | before("level").isNotNull() | before("blank") | (F.col("code") != before("code")) | before("no").isNull()
    l = l.withColumn("block", F.sum(F.when(F.coalesce(starts, F.lit(True)), 1).otherwise(0)).over(order)).where(~F.col("blank") & ~F.col("fence"))
    blocks = l.groupBy("doc_id", "block").agg(
        F.max("level").alias("level"),
        F.max("code").alias("code"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("no", "line"))), lambda x: x["line"]), "\n").alias("text"),
    )
    kind = F.when(F.col("level").isNotNull(), "heading").when(F.col("code"), "code").otherwise("paragraph")
    text = F.when(F.col("level").isNotNull(), F.regexp_replace("text", r"^#{1,6}\s+", "")).otherwise(F.col("text"))
    return blocks.select("doc_id", "block", kind.alias("kind"), "level", F.btrim(text).alias("text"))


def heading_paths(blocks: DataFrame) -> DataFrame:
    """blocks with ``path``: the headings a block stands under, outermost first. A heading resets all deeper ones."""
    upto = Window.partitionBy("doc_id").orderBy("block").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    path = []
    for level in range(1, 7):
        own = F.last(F.when(F.col("level") == level, F.struct("block", "text")), True).over(upto)
        reset = F.last(F.when(F.col("level") < level, F.col("block")), True).over(upto)
        path.append(F.when(own.isNotNull() & (reset.isNull() | (own["block"] > reset)), own["text"]))
    return blocks.withColumn("path", F.array_compact(F.array(*path)))


def code_symbols(docs: DataFrame) -> DataFrame:
    """(doc_id, symbol, start, end, text): each declaration with the lines up to the next; lines count from 1."""
    order = Window.partitionBy("doc_id").orderBy("no")
    l = lines(docs).withColumn("symbol", F.nullif(F.regexp_extract("line", SYMBOL, 1), F.lit("")))
    l = l.withColumn("block", F.sum(F.col("symbol").isNotNull().cast("int")).over(order)).where("block > 0")
    return l.groupBy("doc_id", "block").agg(
        F.max("symbol").alias("symbol"),
        (F.min("no") + 1).alias("start"),
        (F.max("no") + 1).alias("end"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("no", "line"))), lambda x: x["line"]), "\n").alias("text"),
    ).drop("block")


#: (target, most, overlap) tokens of a chunk of prose and of code; fixed values.
PROSE, CODE = (420, 650, 60), (300, 550, 60)
_PIECE = re.compile(r"[0-9A-Za-z_]+|[^\s]")


def tokens_of(text: str) -> int:
    """As functions.text.model_tokens, but 0 for an empty text: a quarter of each ASCII word, one for any other visible character."""
    return sum(-(-len(m) // 4) if m[0].isascii() and (m[0].isalnum() or m[0] == "_") else 1 for m in _PIECE.findall(text))


def hard_split(text: str, most: int) -> list[str]:
    """The text cut where the next character would take a piece over ``most`` tokens."""
    out, start, spent = [], 0, 0
    for m in _PIECE.finditer(text):
        at, left = m.start(), len(m[0])
        while left:
            word = m[0][0].isascii() and (m[0][0].isalnum() or m[0][0] == "_")
            fits = min(left, 4 * (most - spent) if word else most - spent)
            if fits <= 0:
                out.append(text[start:at])
                start, spent = at, 0
                continue
            spent += -(-fits // 4) if word else fits
            at, left = at + fits, left - fits
    return [*out, text[start:]]


def safe_split(text: str, most: int) -> list[str]:
    """The text in pieces of at most ``most`` tokens: whole paragraphs if each fits, else whole lines, and lines that don't fit cut."""
    if tokens_of(text) <= most:
        return [text]

    def joined(parts: list[str], between: str) -> list[str]:
        pieces, sizes = [], []
        for part in parts:
            n = tokens_of(part)
            if pieces and sizes[-1] + n <= most:
                pieces[-1], sizes[-1] = pieces[-1] + between + part, sizes[-1] + n
            else:
                pieces.append(part), sizes.append(n)
        return pieces

    paragraphs = re.split(r"\n{2,}", text)
    if len(paragraphs) > 1:
        pieces = joined(paragraphs, "\n\n")
        if all(tokens_of(x) <= most for x in pieces):
            return pieces
    return [x for piece in joined(text.split("\n"), "\n") for x in ([piece] if tokens_of(piece) <= most else hard_split(piece, most))]


def pack_atoms(atoms: list[tuple[str, list[str], str | None]], target: int, most: int, overlap: int) -> list[tuple[str, int, list[str], str]]:
    """(text, tokens, path, key) of chunks of atoms (text, path, symbol) in order.

    A chunk is closed when it has ``target`` tokens or the next atom would take it over ``most``; the next one begins with
    the atoms at its end that fit into ``overlap`` tokens, unless there is no room for them. Path and key are those of a
    chunk's first atom: its symbol, else its headings, else the chunk's number, and the beginning of the text's hash.
    """
    chunks, now, size = [], [], 0

    def close() -> None:
        nonlocal now, size
        text, (_, path, symbol, _) = "\n\n".join(a[0] for a in now), now[0]
        base = symbol or "/".join(path) or f"chunk-{len(chunks)}"
        chunks.append((text, tokens_of(text), path, f"{base}:{hashlib.sha256(text.encode()).hexdigest()[:12]}"))
        kept, room = [], overlap
        for atom in reversed(now):
            if atom[3] > room:
                break
            kept.insert(0, atom)
            room -= atom[3]
        now, size = kept, overlap - room

    for text, path, symbol in atoms:
        for piece in safe_split(text, most):
            n = max(1, tokens_of(piece))
            if now and (size >= target or size + n > most):
                close()
            if now and size + n > most:
                now, size = [], 0
            now.append((piece, path, symbol, n))
            size += n
    if now:
        close()
    return chunks


def structured_atoms(docs: DataFrame) -> DataFrame:
    """(doc_id, no, text, path, symbol, code) of docs (doc_id, text, code): declarations of code, blocks of prose under their
    headings; headings are no atoms, white space and compatibility forms are normalised."""
    prose = heading_paths(markdown_blocks(docs.where("NOT code"))).where("kind <> 'heading'").select("doc_id", F.col("block").alias("no"), "text", "path", F.lit(None).cast("string").alias("symbol"), F.lit(False).alias("code"))
    code = code_symbols(docs.where("code")).select("doc_id", F.col("start").alias("no"), "text", F.array().cast("array<string>").alias("path"), "symbol", F.lit(True).alias("code"))
    return prose.union(code).withColumn("text", tx.collapsed(tx.nfkc(F.col("text")))).where("text <> ''")


def chunks(docs: DataFrame) -> DataFrame:
    """(doc_id, ordinal, tokens, path, key, text): structured chunks of docs (doc_id, text, code), each document apart.

    Null and blank texts have no chunks. The atoms of a document stream by in order and are packed when it ends.
    """
    kind = dict(docs.dtypes)["doc_id"]

    def pack(frames):
        own, atoms, policy = None, [], PROSE

        def rows():
            return [(own, i, n, list(path), key, text) for i, (text, n, path, key) in enumerate(pack_atoms(atoms, *policy))]

        for frame in frames:
            out = []
            for doc, text, path, symbol, code in zip(*(frame[c].tolist() for c in ("doc_id", "text", "path", "symbol", "code"))):
                if doc != own:
                    out += rows()
                    own, atoms, policy = doc, [], CODE if code else PROSE
                atoms.append((text, path, symbol))
            yield pd.DataFrame(out, columns=["doc_id", "ordinal", "tokens", "path", "key", "text"])
        yield pd.DataFrame(rows(), columns=["doc_id", "ordinal", "tokens", "path", "key", "text"])

    ordered = structured_atoms(docs).repartition("doc_id").sortWithinPartitions("doc_id", "no")
    return ordered.mapInPandas(pack, f"doc_id {kind}, ordinal int, tokens long, path array<string>, key string, text string")
