"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_MADE: list[str] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that spark.checkpoint.dir names. Without that setting a local session (tests, trials) gets a local folder; on a
    cluster it is an error, since no local folder is shared."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{tempfile.gettempdir()}/spark-checkpoints"
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _MADE.append(path)
    return path


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Tables written inside leave no shuffle files behind: these go when the write ends, not when the driver happens to collect garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, written once and read back: cuts the lineage and survives lost executors."""
    path = scratch(df.sparkSession, name)
    with tidy(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written(df: DataFrame, path: str, mode: str = "error") -> None:
    """df, written to a folder in little space: the encodings of Parquet's second version keep what neighbouring values share once, so order the rows before."""
    with tidy(df.sparkSession):
        df.write.option("compression", "zstd").option("parquet.writer.version", "PARQUET_2_0").mode(mode).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    own = spark._jvm.org.apache.hadoop.fs.Path(path)
    return own.getFileSystem(spark._jsc.hadoopConfiguration()).exists(own)


def appended(parts: Iterable[DataFrame], path: str) -> DataFrame:
    """Tables of one shape, at least one, written to a new folder one after another and read back as one: only one part's shuffle files are on disk at a time.
    A part is asked for when the one before it is written."""
    for i, part in enumerate(parts):
        written(part, path, "append" if i else "error")
    return part.sparkSession.read.schema(part.schema).parquet(path)


def folders(df: DataFrame, name: str, by: str, values: Iterable[int]) -> list[tuple[str, DataFrame]]:
    """df dealt to folders by a column of numbers, in one write without a shuffle: (folder, its rows without the column) for each of the values, which are all that
    occur. drop() takes a folder when its rows are done with."""
    spark, each = df.sparkSession, list(values)
    path = scratch(spark, name)
    rest = df.drop(by).schema
    with tidy(spark):
        df.write.option("compression", "zstd").partitionBy(by).parquet(path)
    own = [f"{path}/{by}={x}" for x in each]
    made = spark._jvm.org.apache.hadoop.fs.Path
    for x in own:  # of a value without rows
        made(x).getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(made(x))
    return [(x, spark.read.schema(rest).parquet(x)) for x in own]


def small(df: DataFrame, most: int = 8 << 20) -> bool:
    """Whether df's values take no more than `most` bytes, as measured."""
    taken = lambda c, kind: F.size(c) * 8 if kind.startswith("array") else F.octet_length(F.col(c).cast("string"))
    width = [F.coalesce(taken(c, kind), F.lit(0)) + 16 for c, kind in df.dtypes]
    return (df.agg(F.sum(sum(width[1:], width[0]))).first()[0] or 0) <= most


def sent(df: DataFrame, most: int = 8 << 20) -> DataFrame:
    """df, sent whole to all tasks where it is joined if it is small(); else the planner chooses."""
    return F.broadcast(df) if small(df, most) else df


def drop(spark: SparkSession, path: str) -> None:
    """Delete a folder that scratch() named, or one within it, before release() does."""
    own = spark._jvm.org.apache.hadoop.fs.Path(path)
    own.getFileSystem(spark._jsc.hadoopConfiguration()).delete(own, True)
    if path in _MADE:  # or a folder within one
        _MADE.remove(path)


def release(spark: SparkSession) -> int:
    """Delete the intermediate tables that this process made, once nothing reads them any more; returns their number."""
    n = len(_MADE)
    while _MADE:
        path = spark._jvm.org.apache.hadoop.fs.Path(_MADE.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return n
