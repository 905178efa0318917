"""Connected components by alternating large-star and small-star rounds.

Each round is two aggregations and two equi-joins on the edges; nothing is collected but one count and one checksum.
The rounds are logarithmic in a component's diameter in practice. Edge tables are stored after each round, so lineage stays
short. A node with a very large neighbourhood only enters aggregations that combine before the shuffle and joins whose other
side has one row for it, which adaptive execution can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.plans.scratch import stored


def _mark(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("x")).first()
    return row["n"], row["x"]


def _star(edges: DataFrame, both_ways: bool) -> DataFrame:
    """Every node's neighbours are tied to the node's least neighbour: to all larger ones (large star, over both directions),
    or, over edges that point to the lesser node, all of them (small star)."""
    out = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if both_ways else edges
    least = out.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    tied = out.join(least, "u")
    new = tied.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")) if both_ways else tied.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return new.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of an edge; component is the least node that can be reached.

    Null ends and loops are left out, repeated edges count once; an empty edge table gives an empty result.
    """
    start = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a <> b")
    now = stored(start.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before = _mark(now)
    for _ in range(max_rounds):
        now = stored(_star(_star(now, True), False), "edges")
        after = _mark(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = now.select(F.col("v").alias("node")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots.select("node", F.col("node").alias("component")))
