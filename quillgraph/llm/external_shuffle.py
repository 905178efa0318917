"""Two-pass external shuffle into shards.

Pass one scatters the records uniformly over buckets that fit in memory, by a seeded hash of the record. Pass two reads each bucket
whole, puts its rows in a fixed order, and draws a Fisher-Yates permutation seeded by (seed, bucket). Buckets one
after another give one random order of all records; shard s holds the positions p with p * shards // rows = s, so the shards'
row counts differ by one at most (the law is `rows`), and a record's slot is its distance from its shard's start.

The only record-sized shuffle is the scatter. Bucket offsets come from a count per bucket over the hashed columns alone
and travel to the records with that shuffle. Copies of one record would meet in one bucket, so wherever a hash has more than `copies` rows
each of them gets a number that is part of the hash. These rows are written once with their numbers, so that what counts them and what
deals them agree even if an executor is lost; which copy has which number matters to no one, since they are equal in all that is hashed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillgraph.plans.scratch import scratch, stored

LAW = "rows"


def fisher_yates(n: int, seed: int, bucket: int) -> np.ndarray:
    """A permutation of range(n): each place i from the last swaps with a uniform one of 0..i."""
    order = np.arange(n)
    draws = np.random.Generator(np.random.PCG64([seed, bucket])).random(n)
    swap = (draws * np.arange(1, n + 1)).astype(np.int64).tolist()
    values = order.tolist()
    for i in range(n - 1, 0, -1):
        j = swap[i]
        values[i], values[j] = values[j], values[i]
    return np.array(values, np.int64)


def _permute(seed: int, columns: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("__es_key", "ascending"), ("__es_tie", "ascending")])
        order = fisher_yates(table.num_rows, seed, table["__es_bucket"][0].as_py())
        table = table.take(pa.array(order))
        position = np.arange(table.num_rows) + table["__es_start"][0].as_py()
        return pa.Table.from_arrays([*table.columns[:columns], pa.array(position, pa.int64())], names=[*table.column_names[:columns], "__es_position"])

    return run


def shuffle(docs: DataFrame, *, key: Column, size: Column, shards: int = 8, seed: int = 20240229, bucket_bytes: int = 8 << 20, copies: int = 10_000) -> DataFrame:
    """docs with `shard` (0 to shards - 1) and `slot` (gapless from 0 in each shard); the same rows give the same order again.

    key is a 64-bit hash of what tells records apart (null counts as zero), size a record's bytes, for the buckets' number. Every row,
    repeated ones too, gets a place; an empty table stays empty. Columns named shard or slot are replaced.
    """
    docs = docs.drop("shard", "slot")
    mark = F.coalesce(key, F.lit(0)).cast("long")
    facts = docs.agg(F.count("*").alias("rows"), F.sum(size).alias("bytes")).first()
    rows, buckets = facts["rows"], 1 + int(facts["bytes"] or 0) // bucket_bytes
    keyed = docs.withColumn("__es_key", mark)
    hot = stored(keyed.groupBy("__es_key").agg(F.count("*").alias("__es_n")).where(F.col("__es_n") > copies).select(F.col("__es_key").alias("__es_hot")), "hot-keys")
    plain = F.lit(0).cast("long")
    if hot.isEmpty():
        keyed = keyed.withColumn("__es_tie", plain)
    else:
        same = F.col("__es_key") == F.col("__es_hot")
        numbered = stored(keyed.join(hot, same).drop("__es_hot").withColumn("__es_tie", F.monotonically_increasing_id()), "hot-rows")
        keyed = keyed.join(hot, same, "left_anti").withColumn("__es_tie", plain).unionByName(numbered)
    keyed = keyed.withColumn("__es_bucket", F.pmod(F.xxhash64("__es_key", "__es_tie", F.lit(seed)), F.lit(buckets)))
    counts = keyed.groupBy("__es_bucket").agg(F.count("*").alias("n")).withColumn("span", F.expr("__es_bucket div 4096"))
    spans = counts.groupBy("span").agg(F.sum("n").alias("m"))  # prefix sums in two levels
    spans = spans.select(F.col("span").alias("s"), (F.sum("m").over(Window.orderBy("span")) - F.col("m")).alias("before"))
    within = F.sum("n").over(Window.partitionBy("span").orderBy("__es_bucket")) - F.col("n")
    starts = counts.withColumn("within", within).join(spans, F.col("span") == F.col("s"))
    starts = stored(starts.select(F.col("__es_bucket").alias("__es_b"), (F.col("before") + F.col("within")).alias("__es_start")), "bucket-starts")
    dealt = keyed.join(starts, keyed["__es_bucket"] == starts["__es_b"]).drop("__es_b")
    schema = T.StructType([*docs.schema.fields, T.StructField("__es_position", T.LongType())])
    placed = dealt.groupBy("__es_bucket").applyInArrow(_permute(seed, len(docs.columns)), schema)
    shard = F.expr(f"__es_position * {shards} div {max(rows, 1)}")
    start = F.expr(f"(shard * {rows} + {shards - 1}) div {shards}")
    return placed.withColumn("shard", shard.cast("int")).withColumn("slot", F.col("__es_position") - start).drop("__es_position")


def write(shuffled: DataFrame, path: str | None = None) -> str:
    """Write the shards, one folder each, records in order of their slots; returns the path."""
    path = path or scratch(shuffled.sparkSession, "shards")
    shuffled.repartition("shard", F.expr("slot div 100000")).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
    return path
