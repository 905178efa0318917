"""Alias overrides, export and durable tables."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def overrides(spark: SparkSession, path: str | None) -> DataFrame:
    """(alias, target) addresses from a JSON file with key person_aliases; a missing file gives an empty table."""
    empty = spark.createDataFrame([], "alias string, target string")
    if path is None:
        return empty
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return empty
    raw = spark.read.text(path, wholetext=True)
    parsed = raw.select(F.from_json("value", "person_aliases map<string,string>").alias("x"))
    return parsed.select(F.explode("x.person_aliases").alias("alias", "target"))


def export_graph(path: str, **tables: DataFrame) -> None:
    """One JSON lines folder for each table; entities without deleted ones, all else with its history."""
    for name, df in tables.items():
        _shown(name, df).write.mode("overwrite").json(f"{path}/{name}")


def _shown(name: str, df: DataFrame) -> DataFrame:
    return df.where("deleted_at is null") if name == "entities" else df


class _File:
    """A text file in any file system that Spark can write, written by the driver as it goes."""

    def __init__(self, spark: SparkSession, path: str):
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        self.out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, True)

    def write(self, text: str) -> None:
        self.out.write(bytearray(text, "utf-8"))

    def __enter__(self) -> _File:
        return self

    def __exit__(self, *_) -> None:
        self.out.close()


def export_json(spark: SparkSession, path: str, **tables: DataFrame) -> None:
    """The graph as one JSON file with an array for each table, in order of id. Rows pass through the driver one partition at a time, so no row
    and no task holds a whole table; for graphs too large for one file there is export_graph()."""
    with _File(spark, path) as f:
        for k, (name, df) in enumerate(tables.items()):
            f.write(f"{', ' if k else '{'}{json.dumps(name)}: [")
            rows = _shown(name, df)
            for i, row in enumerate(rows.orderBy("id").select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in rows.columns])).alias("x")).toLocalIterator()):
                f.write(f"{', ' if i else ''}{row.x}")
            f.write("]")
        f.write("}" if tables else "{}")


def pack_file_name(question: str) -> str:
    return question[:40].replace(" ", "_").replace("?", "").replace("/", "_") + ".json"


def export_packs(packs: DataFrame, path: str) -> list[str]:
    """One indented JSON file for each pack, named by its question's first 40 characters (and its id where that name is taken); returns the names."""
    spark, names = packs.sparkSession, []
    for row in packs.orderBy("question_id").select("question_id", "question", F.to_json(F.struct(*packs.columns), {"ignoreNullFields": "false"}).alias("x")).toLocalIterator():
        name = pack_file_name(row.question or "")
        if name in names:
            name = name.removesuffix(".json") + f"_{row.question_id}.json"
        names.append(name)
        with _File(spark, f"{path.rstrip('/')}/{name}") as f:
            f.write(json.dumps(json.loads(row.x), indent=2, ensure_ascii=False))
    return names


class Versions:
    """A folder of tables that change as one: a commit writes all new versions beside the old ones, then one numbered pointer that names them all.

    The newest pointer counts. A pointer is written under another name and renamed, which neither replaces nor removes an older one; so a crash
    at any point leaves the tables as they were before or after the commit. One writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._fs = self._path("x").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _pointers(self) -> list[str]:
        found = self._fs.globStatus(self._path("POINTER-*"))
        return sorted(x.getPath().getName() for x in found) if found else []

    def current(self) -> dict[str, str]:
        names = self._pointers()
        return json.loads(self.spark.read.text(f"{self.path}/{names[-1]}", wholetext=True).first()[0]) if names else {}

    def read(self, name: str) -> DataFrame | None:
        at = self.current().get(name)
        return None if at is None else self.spark.read.parquet(f"{self.path}/{at}")

    def commit(self, **tables: DataFrame) -> None:
        names, new = self._pointers(), self.current()
        for name, df in tables.items():
            new[name] = f"{name}-{uuid.uuid4().hex}"
            df.write.parquet(f"{self.path}/{new[name]}")
        number = 1 + int(names[-1].split("-")[1]) if names else 1
        with _File(self.spark, f"{self.path}/new-pointer") as f:
            f.write(json.dumps(new))
        if not self._fs.rename(self._path("new-pointer"), self._path(f"POINTER-{number:012d}")):
            raise OSError(f"cannot move the pointer in {self.path}")

    def prune(self, keep: int = 2) -> None:
        """Remove all but the newest `keep` versions, once no one reads the older ones."""
        names = self._pointers()
        named = {t for p in names[-keep:] for t in json.loads(self.spark.read.text(f"{self.path}/{p}", wholetext=True).first()[0]).values()}
        for p in names[:-keep]:
            self._fs.delete(self._path(p), False)
        for x in self._fs.listStatus(self._path(".")) if names else []:
            if x.isDirectory() and x.getPath().getName() not in named:
                self._fs.delete(x.getPath(), True)
