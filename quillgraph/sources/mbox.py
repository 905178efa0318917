"""Mail archives: every line that begins with 'From ' starts a message; writers put '>' before such lines of a body.

Two readers give the same rows. read_mbox() takes any path that Spark can read: archives are cut at message boundaries by Spark's
splittable text reader, so a large file is read by many tasks and no row is larger than a message.
spark.read.format("mbox").load(path) reads local files in byte ranges. ord grows with the sorted file names and the place in the file.
"""

from __future__ import annotations

import email
import email.policy
import glob
import hashlib
import os
import re
from collections.abc import Iterator
from datetime import UTC
from email.utils import parseaddr, parsedate_to_datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "ord long, message_id string, in_reply_to string, references array<string>, from_addr string, from_name string, subject string, body_raw string, ts timestamp_ntz, date_ok boolean"
_NAMES = ["ord", "message_id", "in_reply_to", "references", "from_addr", "from_name", "subject", "body_raw", "ts", "date_ok"]
_TYPES = [pa.int64(), pa.string(), pa.string(), pa.list_(pa.string()), pa.string(), pa.string(), pa.string(), pa.string(), pa.timestamp("us"), pa.bool_()]
_BREAK = b"\nFrom "
_WEEKDAY = re.compile(r"^\s*[A-Za-z]{3,9},\s*")
_ESCAPED = re.compile(rb"(?m)^>(>*From )")
#: Bits of ord for the place in a file; the rest numbers the files.
PLACE = 40


def messages_in(f, start: int, end: int, chunk: int = 1 << 20) -> Iterator[tuple[int, bytes]]:
    """(offset, message with its 'From ' line) of the messages that begin in [start, end), in one pass; the last may end beyond."""
    base = max(start - 1, 0)
    f.seek(base)
    data, scan = bytearray(f.read(chunk)), 0
    head = start == 0 and data.startswith(b"From ")
    while True:
        at = data.find(_BREAK, scan)
        if at < 0:
            more = f.read(chunk)
            if not more:
                break
            scan = max(len(data) - len(_BREAK) + 1, 0)
            data += more
            continue
        if head:
            yield base, bytes(data[: at + 1])
        if base + at + 1 >= end:
            return
        del data[: at + 1]
        base, head, scan = base + at + 1, True, 0
    if head:
        yield base, bytes(data)


def body_text(message) -> str:
    """The first text/plain part, decoded; empty if there is none."""
    for part in message.walk():
        if part.get_content_type() == "text/plain" and not part.is_multipart():
            raw = part.get_payload(decode=True) or b""
            try:
                return raw.decode(part.get_content_charset() or "utf-8", "replace")
            except LookupError:
                return raw.decode("utf-8", "replace")
    return ""


def _header(message, name: str) -> str:
    if message[name] is None:
        return ""
    try:
        return str(email.header.make_header(email.header.decode_header(message[name])))
    except (LookupError, ValueError):
        return str(message[name])


def parse(raw: bytes) -> tuple:
    """A row without its ord, of a message without its 'From ' line. An unreadable date is null with date_ok false; the weekday, often wrong in
    old mail, is ignored."""
    raw = _ESCAPED.sub(rb"\1", raw)
    m = email.message_from_bytes(raw, policy=email.policy.compat32)
    head = lambda name: _header(m, name)
    try:
        ts = parsedate_to_datetime(_WEEKDAY.sub("", head("Date")))
        ts = ts.astimezone(UTC).replace(tzinfo=None) if ts.tzinfo else ts
    except (TypeError, ValueError, IndexError, OverflowError):
        ts = None
    name, addr = parseaddr(head("From"))
    own = head("Message-ID").strip() or f"<unknown-{hashlib.md5(raw.rstrip()).hexdigest()[:8]}>"
    body = body_text(m).replace("\r\n", "\n").rstrip("\n")
    return own, head("In-Reply-To").strip(), head("References").split(), addr.strip().lower(), name.strip(), head("Subject"), body, ts, ts is not None


def _after_line(raw: bytes) -> bytes:
    return raw[raw.find(b"\n") + 1 :] if b"\n" in raw else b""


class MboxPartition(InputPartition):
    def __init__(self, path: str, number: int, start: int, end: int):
        super().__init__(number)
        self.path, self.number, self.start, self.end = path, number, start, end


class MboxReader(DataSourceReader):
    def __init__(self, path: str, split_bytes: int):
        self.path, self.split_bytes = path.removeprefix("file://"), split_bytes

    def partitions(self):
        found = sorted(glob.glob(os.path.join(self.path, "*")) if os.path.isdir(self.path) else glob.glob(self.path))
        sizes = [(p, os.path.getsize(p)) for p in found if os.path.isfile(p)]
        return [MboxPartition(p, i, a, min(a + self.split_bytes, n)) for i, (p, n) in enumerate(sizes) for a in range(0, n, self.split_bytes)]

    def read(self, partition):
        if partition is None:
            return
        with open(partition.path, "rb") as f:
            for at, raw in messages_in(f, partition.start, partition.end):
                yield ((partition.number << PLACE) + at, *parse(_after_line(raw)))


class MboxSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "mbox"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return MboxReader(self.options["path"], int(self.options.get("splitBytes", 64 << 20)))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(MboxSource)


def read_mbox(spark: SparkSession, path: str) -> DataFrame:
    """Archives at any path that Spark can read (object stores too), split at message boundaries, parsed in one narrow pass.

    A message's ord is its file's number, then its split's start plus its number in the split: a message takes up more bytes than one, so
    these neither meet nor change their order. The numbers of the files, one name each, travel with the code.
    """
    listed = spark.read.format("binaryFile").load(path).select(F.col("_metadata.file_path").alias("path"))  # names only
    numbers = {p: i for i, p in enumerate(sorted(r.path for r in listed.collect()))}
    if len(numbers) >= 1 << (63 - PLACE):
        raise ValueError(f"{len(numbers)} files have no room in ord")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, n = None, 0
        for batch in batches:
            rows = []
            for file, start, raw in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist(), batch.column("raw").to_pylist(), strict=True):
                now, n = (file, start), n + 1 if now == (file, start) else 0
                if start == 0 and n == 0 and not raw.startswith(b"From "):
                    continue  # what stands before the first message
                rows.append(((numbers[file] << PLACE) + start + n, *parse(_after_line(raw + b"\n"))))  # the break that the reader took
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], _NAMES)

    pieces = spark.read.option("lineSep", _BREAK.decode()).text(path)
    return pieces.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), F.col("value").cast("binary").alias("raw")).mapInArrow(run, SCHEMA)


def _words(text: Column) -> Column:
    """A header's text: line breaks become spaces, and what is not ASCII an encoded word."""
    flat = F.regexp_replace(F.coalesce(text, F.lit("")), r"[\r\n]+", " ")
    return F.when(flat.rlike(r"[^\x00-\x7F]"), F.concat(F.lit("=?utf-8?b?"), F.regexp_replace(F.base64(flat.cast("binary")), r"\s", ""), F.lit("?="))).otherwise(flat)


def write_mbox(messages: DataFrame, path: str) -> None:
    """Write messages (message_id, from_addr, subject, body_raw and, where there, from_name, in_reply_to, references, ts, or a ready `date`
    text) as archives, one file for each partition, in the order of its rows. Nulls leave their header out."""
    has = set(messages.columns)

    def line(name: str, value: Column) -> Column:
        return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\n")), F.lit(""))

    sender = F.col("from_addr")
    if "from_name" in has:
        sender = F.when(F.coalesce("from_name", F.lit("")) == "", sender).otherwise(F.concat(_words(F.col("from_name")), F.lit(" <"), sender, F.lit(">")))
    lines = [line("Message-ID", F.col("message_id")), line("From", sender), line("Subject", _words(F.col("subject")))]
    if "in_reply_to" in has:
        lines.append(line("In-Reply-To", F.col("in_reply_to")))
    if "references" in has:
        lines.append(line("References", F.when(F.size("references") > 0, F.array_join("references", " "))))
    date = F.lit(None).cast("string")
    if "ts" in has:
        date = F.date_format("ts", "d MMM yyyy HH:mm:ss '+0000'")
    if "date" in has:
        date = F.coalesce("date", date)
    body = F.regexp_replace(F.coalesce("body_raw", F.lit("")), r"(?m)^(>*From )", ">$1")
    kind = F.lit('MIME-Version: 1.0\nContent-Type: text/plain; charset="utf-8"\nContent-Transfer-Encoding: 8bit\n\n')
    messages.select(F.concat(F.lit("From nobody Thu Jan  1 00:00:00 1970\n"), *lines, line("Date", date), kind, body, F.lit("\n")).alias("value")).write.text(path)
