"""Row-wise text operators as Column expressions. All are built-in functions, so they stay in one stage."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The patterns below (signature, quotes, bracketed ids, fences, tokens) are fixed values: they define what the operators find.
_EDGE = r"^[\s]+|[\s]+$"


def strip(x: Column) -> Column:
    return F.regexp_replace(x, _EDGE, "")


def strip_signature(body: Column) -> Column:
    """Cut at the first line that is '--' or '-- ', then trim."""
    return strip(F.regexp_replace(body, r"(?s)\n-- ?\n.*$", ""))


def strip_quotes(body: Column) -> Column:
    """Drop the lines that start with '>', then trim."""
    return strip(F.array_join(F.filter(F.split(body, "\n"), lambda line: ~line.startswith(">")), "\n"))


def quoted_ids(raw: Column) -> Column:
    """Bracketed ids with an '@' and a '.', in order of first appearance, in brackets."""
    found = F.filter(F.regexp_extract_all(raw, F.lit(r"<([^>]+@[^>]+)>"), F.lit(1)), lambda c: c.contains("."))
    return F.array_distinct(F.transform(found, lambda c: F.concat(F.lit("<"), c, F.lit(">"))))


def thread_root(references: Column, in_reply_to: Column, own: Column) -> Column:
    """First reference, else the parent, else the message itself."""
    return F.coalesce(F.get(references, F.lit(0)), F.nullif(in_reply_to, F.lit("")), own)


def combined(subject: Column, body: Column) -> Column:
    """The text that offsets refer to."""
    return F.concat(F.lit("Subject: "), subject, F.lit("\n\nBody:\n"), body)


def clamp(start: Column, end: Column, excerpt: Column, length: Column) -> Column:
    """struct(excerpt, char_start, char_end, valid): offsets forced into the text; an empty span is not valid."""
    s = F.greatest(start, F.lit(0))
    e = F.least(end, length)
    e = F.when(e <= s, F.least(s + F.char_length(excerpt), length)).otherwise(e)
    return F.struct(F.substring(excerpt, 1, 600).alias("excerpt"), s.alias("char_start"), e.alias("char_end"), (e > s).alias("valid"))


def name_normalize(name: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(name), r"[^a-z0-9\s]", " "), r"\s+", " "))


def username(email: Column) -> Column:
    return F.translate(F.lower(F.split_part(email, F.lit("@"), F.lit(1))), "._-", "")


def name_tokens(name: Column) -> Column:
    return F.array_distinct(F.filter(F.split(name_normalize(name), " "), lambda t: t != ""))


def tokenize(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), F.lit(1))


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[ \t\n\r\f\x0B]+"), lambda w: w != "")


def shingles(text: Column, k: int = 4) -> Column:
    """All runs of k words; with fewer words, one run of all. Empty only for blank texts."""
    return F.transform(
        F.array(words(text)), lambda w: F.when(F.size(w) == 0, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - k + 1, F.lit(1))), lambda i: F.array_join(F.slice(w, i, k), " ")))
    )[0]


def emails(values: Column) -> Column:
    return F.transform(values, lambda e: F.lower(F.trim(e)))


def jaccard(a: Column, b: Column) -> Column:
    """0 if either set is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def fenced_json(raw: Column) -> Column:
    """The inside of the first fenced block if there is one, trimmed."""
    inner = F.regexp_extract(raw, r"(?s)```(?:json)?\s*(.*?)\s*```", 1)
    return strip(F.when(raw.rlike(r"(?s)```(?:json)?\s*.*?\s*```"), inner).otherwise(raw))
