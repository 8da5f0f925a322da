"""Text expressions: normalising, terms, token estimates, identities."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What separates terms: all but letters, digits and _ . / : -
TERM_BREAK = r"[^\p{L}\p{N}_./:-]+"
WORD_BREAK = r"[^\p{L}\p{N}_-]+"


@F.pandas_udf(T.StringType())
def _nfkc(values: pd.Series) -> pd.Series:
    return values.map(lambda v: None if v is None else unicodedata.normalize("NFKC", v))


def nfkc(text: Column) -> Column:
    """Compatibility composition; Spark has no function for it, so text beyond ASCII passes a vectorised one."""
    return F.when(text.rlike(r"[^\x00-\x7F]"), _nfkc(text)).otherwise(text)


def collapsed(text: Column) -> Column:
    """CR LF and CR become LF, runs of spaces and tabs one space, white space at the ends goes."""
    lines = F.regexp_replace(text, r"\r\n?", "\n")
    return F.regexp_replace(F.regexp_replace(lines, r"[ \t]+", " "), r"(?U)^\s+|\s+$", "")


def bounded(text: Column, most: int) -> Column:
    """One line of at most ``most`` characters; a cut text ends with an ellipsis."""
    line = F.btrim(F.regexp_replace(collapsed(text), r"(?U)\s+", " "))
    return F.when(F.char_length(line) <= most, line).otherwise(F.concat(F.rtrim(F.substring(line, 1, most - 1)), F.lit("…")))


def _accents() -> tuple[str, str]:
    """Latin letters with an accent, and the same letters without: those that decompose to an ASCII letter and a mark."""
    pairs = [(chr(c), unicodedata.normalize("NFD", chr(c))) for c in range(0xC0, 0x250)]
    found = [(c, d[0]) for c, d in pairs if len(d) > 1 and d[0].isascii()]
    return "".join(c for c, _ in found), "".join(d for _, d in found)


ACCENTED, PLAIN = _accents()


def folded(text: Column) -> Column:
    """Lower case without accents on Latin letters."""
    return F.lower(F.translate(text, ACCENTED, PLAIN))


def searched(text: Column) -> Column:
    """Folded terms of two or more characters, in order, with repeats."""
    return F.filter(F.split(folded(text), TERM_BREAK), lambda t: F.char_length(t) > 1)


def terms(text: Column) -> Column:
    """Distinct lower-case terms of two or more characters, in order."""
    return F.array_distinct(F.filter(F.split(F.lower(text), TERM_BREAK), lambda t: F.char_length(t) > 1))


def lexical_terms(text: Column) -> Column:
    """Distinct words of two or more characters among the first 128, and pairs of Han characters; 256 at most."""
    lower = F.lower(collapsed(text))
    words = F.slice(F.filter(F.split(lower, WORD_BREAK), lambda t: F.char_length(t) >= 2), 1, 128)
    runs = F.regexp_extract_all(lower, F.lit(r"(\p{IsHan}{2,})"), 1)
    pairs = F.flatten(F.transform(runs, lambda r: F.transform(F.sequence(F.lit(1), F.char_length(r) - 1), lambda i: F.substring(r, i, F.lit(2)))))
    return F.array_distinct(F.slice(F.concat(words, pairs), 1, 256))


def bigrams(text: Column) -> Column:
    """Distinct pairs of characters of the lower-case text without punctuation, symbols and white space."""
    plain = F.regexp_replace(F.lower(text), r"(?U)[\p{P}\p{S}\s]+", "")
    one = F.split(plain, "(?!^)(?s)(?=.)")
    several = F.transform(F.array(one), lambda c: F.transform(F.sequence(F.lit(0), F.greatest(F.size(c) - 2, F.lit(0))), lambda i: F.concat_ws("", F.get(c, i), F.get(c, i + 1))))[0]
    return F.when(plain == "", F.array().cast("array<string>")).otherwise(F.array_distinct(several))


def shared(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b))


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(shared(a, b) / union)


def overlap(a: Column, b: Column) -> Column:
    """Shared elements over the larger set; 0 if either is empty."""
    most = F.greatest(F.size(a), F.size(b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(shared(a, b) / most)


def model_tokens(text: Column, space: str = r"\s") -> Column:
    """A quarter of each ASCII word's length, rounded up, and one for each other visible character; at least 1. ``space``, part of a
    pattern's class, is what isn't visible."""
    words = F.regexp_extract_all(text, F.lit("([0-9A-Za-z_]+)"), 1)
    quarter = F.aggregate(words, F.lit(0).cast("long"), lambda a, w: a + F.ceil(F.char_length(w) / 4))
    return F.greatest(F.lit(1).cast("long"), quarter + F.char_length(F.regexp_replace(text, rf"(?U)[0-9A-Za-z_{space}]", "")))


def byte_bound(text: Column) -> Column:
    return F.greatest(F.lit(1), F.octet_length(text))


def stable_hash(domain: str, *parts: Column) -> Column:
    """SHA-256 over the domain and the parts, each led by its length in bytes."""
    fields = [F.lit(domain), *parts]
    return F.sha2(F.concat(*(x for f in fields for x in (F.octet_length(f).cast("string"), F.lit(":"), f))), 256)


def url_component(text: Column) -> Column:
    """Percent-encoding of a URL component: unlike a form's, a space is %20 and ! ' ( ) * stay."""
    out = F.replace(F.url_encode(text), F.lit("+"), F.lit("%20"))
    for code, plain in (("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        out = F.replace(out, F.lit(code), F.lit(plain))
    return out


def ordered_items(text: Column) -> Column:
    """array<struct<position, value>> of a list's lines; null unless there are three and an arrow or bullets mark them."""
    lines = F.split(F.replace(text, F.lit("→"), F.lit("\n")), "\r?\n")
    items = F.filter(F.transform(lines, lambda x: F.regexp_replace(F.btrim(x), r"^[-*]\s*", "")), lambda x: x != "")
    marked = F.contains(text, F.lit("→")) | text.rlike(r"\n\s*[-*]")
    return F.when((F.size(items) >= 3) & marked, F.transform(items, lambda x, i: F.struct((i + 1).alias("position"), x.alias("value"))))


#: Patterns of secrets and what stands in their place; fixed values. The last has no group, so "$1" stays as it is.
SECRETS = (
    (r"\bsk-[a-zA-Z0-9_-]{20,}\b", "sk-****"),
    (r"\bghp_[a-zA-Z0-9]{20,}\b", "ghp_****"),
    (r"\bAKIA[0-9A-Z]{12,}\b", "AKIA****"),
    (r"(?i)\bBearer\s+[a-zA-Z0-9._\-+=/]{10,}\b", "Bearer ****"),
    (r"(?i)(?:password|passwd|密码)\s*[:=]\s*\S+", r"\$1: ****"),
)


def redacted(text: Column) -> Column:
    for pattern, instead in SECRETS:
        text = F.regexp_replace(text, pattern, instead)
    return text
