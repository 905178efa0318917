"""Wu-Manber multi-pattern search over words, for finding benchmark passages in documents.

The symbols are words. For patterns of m words and blocks of b = min(2, m) words, SHIFT gives for each block that ends somewhere
in a pattern how far the window may move at least; blocks in no pattern shift by m - b + 1, so most words are never looked
at. Where the shift is zero, the bucket of the block (the patterns that end in it) is compared word by word. Patterns of
one length share a machine; shorter ones have their own, so that they don't shorten the common shift.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillgraph.plans.scratch import scratch

from .common import small_batches, text_bytes

#: Words are runs of ASCII digits and letters and of all that is not ASCII; other bytes become a space, A-Z lower case.
WORDS_ONLY = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(WORDS_ONLY).split()


def windows_of(words: list[bytes], size: int) -> list[tuple[bytes, ...]]:
    """All runs of `size` words; a shorter sequence, if not empty, is one window."""
    return [tuple(words[i : i + size]) for i in range(len(words) - size + 1)] if len(words) >= size else [tuple(words)] * bool(words)


class Machine:
    """Patterns of one length."""

    def __init__(self, patterns: dict[tuple[bytes, ...], object], length: int):
        self.patterns, self.m, self.b = patterns, length, min(2, length)
        self.most = length - self.b + 1
        self.shift: dict[tuple[bytes, ...], int] = {}
        self.bucket: dict[tuple[bytes, ...], list[tuple[bytes, ...]]] = {}
        for p in patterns:
            for end in range(self.b, length + 1):
                block = p[end - self.b : end]
                self.shift[block] = min(self.shift.get(block, self.most), length - end)
            self.bucket.setdefault(p[length - self.b :], []).append(p)
        self.by_prefix = {k: {p for p in v} for k, v in self.bucket.items()}

    def find(self, words: list[bytes]) -> Iterator[tuple[int, tuple[bytes, ...]]]:
        """(start, pattern) of every occurrence, by start."""
        m, get, most, end, n = self.m, self.shift.get, self.most, self.m, len(words)
        if self.b == 1:
            for i, w in enumerate(words):
                if (w,) in self.patterns:
                    yield i, (w,)
            return
        while end <= n:
            step = get((words[end - 2], words[end - 1]), most)
            if step:
                end += step
                continue
            text = tuple(words[end - m : end])
            if text in self.by_prefix[text[-2:]]:
                yield end - m, text
            end += 1


class Scanner:
    """All windows of a block of items."""

    def __init__(self, items: Iterable[tuple[object, bytes]], size: int):
        owners: dict[tuple[bytes, ...], set] = {}
        for item, text in items:
            for window in windows_of(words_of(text), size):
                owners.setdefault(window, set()).add(item)
        by_length: dict[int, dict] = {}
        for window, own in owners.items():
            by_length.setdefault(len(window), {})[window] = own
        self.machines = [Machine(p, n) for n, p in sorted(by_length.items())]

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Merged word ranges [start, end) inside occurrences, and the items whose windows occur."""
        found, items = [], set()
        for machine in self.machines:
            for start, window in machine.find(words):
                found.append((start, start + machine.m))
                items |= machine.patterns[window]
        return merge(found), items


def merge(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _scan(items: list[tuple[object, bytes]], size: int, text: str, made: tuple[str, str, str]):
    types = (pa.int64(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])), pa.list_(pa.string()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(items, size)
        for whole in batches:
            for batch in small_batches(whole, text, 4 << 20):
                n_words, spans, hit = [], [], []
                before = [batch.column(c).to_pylist() if c in batch.schema.names else [None] * batch.num_rows for c in made[1:]]
                for x, old_spans, old_items in zip(text_bytes(batch.column(text)), *before, strict=True):
                    words = words_of(x)
                    ranges, own = scanner.scan(words)
                    if old_spans:
                        ranges = merge([*ranges, *((r["start"], r["end"]) for r in old_spans)])
                    n_words.append(len(words))
                    spans.append([{"start": a, "end": b} for a, b in ranges])
                    hit.append(sorted({*own, *(old_items or ())}))
                columns = {c: batch.column(c) for c in batch.schema.names} | {c: pa.array(x, t) for c, x, t in zip(made, (n_words, spans, hit), types, strict=True)}
                yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return run


def scan(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 10, block_bytes: int = 8 << 20, prefix: str = "decon_") -> DataFrame:
    """docs with three more columns: {prefix}n_words; {prefix}spans, the merged word ranges [start, end) that lie in an occurrence of
    any window of `window` consecutive words of an item; {prefix}items, the items (as text, sorted) of those windows.

    No shuffle: the benchmark is cut into blocks of about block_bytes of text by a hash, each is sent to the executors on its own
    and scanned for in one narrow pass over the documents, which adds to what the passes before it found; so the size of what is sent
    at once is bounded and the benchmark's is not. Null and empty texts have no words; items without words or without an id occur
    nowhere; equal items all count; an empty benchmark hits nothing. Columns of docs that have the names of the three are replaced, all others stay.
    An empty docs table gives an empty result; very long texts and repeated rows are like others.
    """
    own = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(item_text_col).cast("string").alias("text")).where("item is not null and text is not null")
    total = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = 1 + total // block_bytes
    made = (f"{prefix}n_words", f"{prefix}spans", f"{prefix}items")
    if blocks > 1:  # so that each pass reads its own block alone
        path = scratch(docs.sparkSession, "benchmark-blocks")
        own.withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(blocks))).repartition("block").write.partitionBy("block").parquet(path)
        own = docs.sparkSession.read.schema("item string, text string, block long").parquet(path)
    out = docs.drop(*made)
    between = [f"__wm_{c}" for c in ("words", "spans", "items")]  # between passes; no column of docs is taken for theirs
    while any(c in out.columns for c in between):
        between = [f"_{c}" for c in between]
    extra = T._parse_datatype_string(f"`{between[0]}` long, `{between[1]}` array<struct<start: int, end: int>>, `{between[2]}` array<string>").fields
    schema = T.StructType([*out.schema.fields, *extra])
    for k in range(blocks):
        block = own.where(F.col("block") == k) if blocks > 1 else own
        items = [(r.item, r.text.encode()) for r in block.collect()]  # about block_bytes
        out = out.mapInArrow(_scan(items, window, text_col, tuple(between)), schema)
    return out.withColumnsRenamed(dict(zip(between, made, strict=True)))


def digest(items: list[str]) -> str:
    """What op7 reports of a list of items."""
    return hashlib.sha256(",".join(items).encode()).hexdigest()


def clean(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", window: int = 10) -> DataFrame:
    """The documents without any occurrence; the columns stay as they are."""
    marked = scan(docs, benchmark, text_col=text_col, window=window, prefix="__decon_")
    return marked.where(F.size("__decon_spans") == 0).select([F.col(f"`{c}`") for c in docs.columns])
