"""What the operators of this subpackage share: scratch tables, Arrow payloads, byte views of text columns."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space of the word rules: space and \t \n \v \f \r. bytes.split() splits on the same bytes.
WORD = r"[^\x20\x09-\x0D]+"


def crc_share(key: Column, parts: int, rest: int) -> Column:
    """crc32 of the key's text modulo parts equals rest; false for null."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % parts == rest, F.lit(False))


def text_bytes(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    """The texts in UTF-8; null is empty."""
    return pc.fill_null(column.cast(pa.large_string()), "").cast(pa.large_binary()).to_pylist()


def pack(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def unpack(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(pa.py_buffer(data)).read_all()


def of_hash(word: bytes, parts: int) -> int:
    return zlib.crc32(word) % parts


def by_batch(f: Callable[[pa.RecordBatch], pa.RecordBatch]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """f for mapInArrow: one batch in, one batch out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield f(batch)

    return run


def small_batches(batch: pa.RecordBatch, text: str, limit: int) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about `limit` bytes of text each, so that what is made of a slice stays bounded."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(text)), 0), dtype=np.int64)
    cuts = np.flatnonzero(np.diff(np.cumsum(sizes) // limit)) + 1
    for a, b in zip(np.r_[0, cuts], np.r_[cuts, batch.num_rows], strict=True):
        yield batch.slice(a, b - a)
