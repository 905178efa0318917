"""Exact and near duplicates of messages."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillgraph.plans.scratch import stored


def exact(messages: DataFrame, key: Column, *, ord_col: str = "ord", id_col: str = "message_id") -> DataFrame:
    """messages with `sha` and `duplicate_of`: the id of the first message (by ord, then id) with the same key, null for that one itself. Rows that
    agree in ord and id are one message.

    The first is an aggregate (combined before the shuffle) joined back, so a body that a third of all messages share costs a
    join that can be split, not one task.
    """
    keyed = messages.withColumn("sha", F.sha2(key, 256))
    first = keyed.groupBy("sha").agg(F.min(F.struct(ord_col, id_col)).alias("__first"))
    out = keyed.join(first, "sha")
    return out.withColumn("duplicate_of", F.when(F.struct(ord_col, id_col) != F.col("__first"), F.col(f"__first.{id_col}"))).drop("__first")


def simhash(docs: DataFrame, *, id_col: str, text_col: str, bits: int = 64) -> DataFrame:
    """(id, simhash): bit i is set if more than half of the text's 4-word shingles have it in the low half of their md5; null for
    blank texts. One narrow pass: the bits are counted over Arrow batches, a text's shingles never leave its task."""
    import hashlib

    import numpy as np

    def one(text: str | None) -> int | None:
        words = [w for w in re.split("[ \t\n\r\f\x0b]+", (text or "").lower()) if w]
        if not words:
            return None
        count = np.zeros(bits, np.int64)
        grams = max(len(words) - 3, 1)
        for a in range(0, grams, 1 << 14):
            low = b"".join([hashlib.md5(" ".join(words[i : i + 4]).encode()).digest()[8:] for i in range(a, min(a + (1 << 14), grams))])
            count += np.unpackbits(np.frombuffer(low, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)[::-1][:bits]
        value = sum(1 << i for i in range(bits) if count[i] * 2 > grams)
        return value - (1 << 64) if value >> 63 else value

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([one(x) for x in batch.column(1).to_pylist()], pa.int64())], [id_col, "simhash"])

    rows = docs.select(id_col, F.col(text_col).cast("string").alias("__text"))
    return rows.mapInArrow(run, T.StructType([rows.schema[id_col], T.StructField("simhash", T.LongType())]))


def near_pairs(hashes: DataFrame, *, id_col: str, ord_col: str = "ord", hash_col: str = "simhash", most: int = 3, blocks: int = 6) -> DataFrame:
    """(a, b, distance) of rows whose hashes differ in at most `most` bits, a before b by (ord, id), without all pairs of equal hashes: the
    first row of each hash stands for it, is paired with its near ones, and has a pair of distance 0 with each of its copies.

    The hashes are cut into more blocks than differing bits; two near ones agree in `blocks - most` of them, so an equi-join on every choice of so many
    blocks (twenty keys of 32 bits by default) finds all pairs, and keys that wide keep buckets small for billions of hashes. That join is always a merge
    join: a row becomes twenty, which the planner's estimate leaves out, so it would send what doesn't fit the driver.
    """
    own = hashes.where(F.col(hash_col).isNotNull()).select(F.struct(F.col(ord_col).alias("ord"), F.col(id_col).alias("id")).alias("at"), F.col(hash_col).alias("h")).distinct()
    lead = stored(own.groupBy("h").agg(F.min("at").alias("at"), F.count("*").alias("n")), "near-leads")
    edges_ = [64 * i // blocks for i in range(blocks + 1)]
    masks = [((1 << edges_[i + 1]) - 1) ^ ((1 << edges_[i]) - 1) for i in range(blocks)]
    choices = [sum(c) for c in combinations(masks, blocks - most)]
    keyed = lead.select("at", "h", F.posexplode(F.array(*[F.col("h").bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m)) for m in choices])).alias("choice", "key"))
    left, right = keyed.select(F.col("at").alias("a"), F.col("h").alias("ha"), "choice", "key"), keyed.select(F.col("at").alias("b"), F.col("h").alias("hb"), "choice", "key")
    distance = F.bit_count(F.col("ha").bitwiseXOR(F.col("hb")))
    close = left.hint("merge").join(right.hint("merge"), ["choice", "key"]).where((F.col("a") < F.col("b")) & (distance <= most)).select("a", "b", distance.alias("distance")).distinct()
    copies = own.join(lead.where("n > 1").select("h", F.col("at").alias("a")), "h").where("at <> a").select("a", F.col("at").alias("b"), F.lit(0).alias("distance"))
    return close.unionByName(copies).select(F.col("a.id").alias("a"), F.col("b.id").alias("b"), "distance")


def leaders(nodes: DataFrame, pairs: DataFrame, *, id_col: str, ord_col: str = "ord", max_rounds: int = 200) -> DataFrame:
    """(id, leader): the sequential rule 'a row is a duplicate of the first earlier leader it is near to, else a leader' for all rows, earlier by
    (ord, id). pairs as near_pairs() gives them: copies hang on their first row, and share its leader or have it as theirs.

    Rounds over the pairs: a row without undecided or leading earlier neighbours leads; one with an earlier leader is a
    duplicate. Each round decides at least the first undecided row of every group; the loop reads one count a round.
    leader is null for leaders.
    """
    order = nodes.select(F.col(id_col).alias("id"), F.col(ord_col).alias("ord"))
    edges = stored(pairs.where("distance > 0").select("a", "b"), "near-edges")
    touched = edges.select(F.col("b").alias("id")).distinct()
    first = edges.select(F.col("a").alias("id")).distinct().join(touched, "id", "left_anti").select("id", F.lit(1).alias("state"))
    state = stored(first.unionByName(touched.select("id", F.lit(0).alias("state"))), "near-state")
    for _ in range(max_rounds):
        if state.where("state = 0").isEmpty():
            break
        seen = edges.join(state.select(F.col("id").alias("a"), "state"), "a").groupBy(F.col("b").alias("id")).agg(F.max((F.col("state") == 1).cast("int")).alias("led"), F.max((F.col("state") == 0).cast("int")).alias("open"))
        now = F.when(F.col("state") != 0, F.col("state")).when(F.col("led") == 1, 2).when(F.col("open") == 0, 1).otherwise(0)
        state = stored(state.join(seen, "id", "left").select("id", now.cast("int").alias("state")), "near-state")
    else:
        raise RuntimeError(f"undecided rows after {max_rounds} rounds")
    lead = state.where("state = 1").select(F.col("id").alias("a"))
    least = edges.join(lead, "a").join(order.select(F.col("id").alias("a"), F.col("ord").alias("oa")), "a").groupBy(F.col("b").alias("id")).agg(F.min(F.struct("oa", "a")).alias("m"))
    led = stored(least.select("id", F.col("m.a").alias("lead")), "near-led")
    copies = pairs.where("distance = 0").select(F.col("b").alias("id"), "a").join(led.select(F.col("id").alias("a"), "lead"), "a", "left").select("id", F.coalesce("lead", "a").alias("lead"))
    return order.select("id").join(led.unionByName(copies), "id", "left").select(F.col("id").alias(id_col), F.col("lead").alias("leader"))


def thread_roots(messages: DataFrame, *, id_col: str = "message_id", parent_col: str = "in_reply_to") -> DataFrame:
    """(id, root): the message that a chain of parents ends in, by pointer doubling (rounds are logarithmic in a thread's depth).

    A parent that is no message ends the chain at the message itself. Messages whose chain runs into a circle have the least id of that circle as
    their root. An id that occurs more than once is one message, with its least parent.
    """
    links = stored(messages.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.min(parent_col).alias("p")), "parents")
    known = links.select(F.col("id").alias("p"), F.lit(True).alias("ok"))
    # up: the message 2^k steps on; low: the least id among the first 2^k of the chain
    now = stored(links.join(known, "p", "left").select("id", F.when(F.col("ok"), F.col("p")).otherwise(F.col("id")).alias("up"), F.col("id").alias("low")), "roots")
    n, steps = now.count(), 1
    ends = stored(now.where("id = up").select(F.col("id").alias("up")), "thread-ends")
    done = now.join(ends, "up", "left_semi").select("id", F.col("up").alias("root"))
    now = stored(now.join(ends, "up", "left_anti").select("id", "up", "low"), "roots")
    while steps <= n and not now.isEmpty():
        step = now.join(now.select(F.col("id").alias("up"), F.col("up").alias("up2"), F.col("low").alias("low2")), "up", "left").join(done.select(F.col("id").alias("up"), "root"), "up", "left")
        step = stored(step.select("id", "root", F.col("up2").alias("up"), F.least("low", "low2").alias("low")), "roots")
        done = stored(done.unionByName(step.where("root is not null").select("id", "root")), "thread-roots")
        now, steps = step.where("root is null").drop("root"), steps * 2
    circle = now.join(now.select(F.col("id").alias("up"), F.col("low").alias("root")), "up").select("id", "root")
    return done.unionByName(circle).withColumnRenamed("id", id_col)


def quotes_edges(messages: DataFrame) -> DataFrame:
    """(src, dst): messages that quote the id of a message that exists."""
    from quillgraph.functions.text import quoted_ids

    q = messages.select(F.col("message_id").alias("src"), F.explode(quoted_ids(F.col("body_raw"))).alias("dst"))
    return q.join(messages.select(F.col("message_id").alias("dst")).distinct(), "dst", "left_semi").where("src <> dst").select("src", "dst")
