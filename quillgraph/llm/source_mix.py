"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Targets: sources, in order of their names (null last), weigh by a repeating list, and share `total` times all words; no target
exceeds `most` times its source's size: the excess goes to the others by weight until none is above.

Within a source: as many complete epochs as the target holds, each taking every document; for what is left of the target,
documents are taken in order of their exponential keys -ln(u) / w, u a seeded hash of the document and w its quality weight,
until their prefix-summed sizes reach it. The last one goes in if at least half of it fits, so a source's taken words miss its
target by half a document at most, and no document is cut. Each copy of a repeated row counts by itself.

The order is never computed by one task per source: keys fall into bins of equal width of their logarithm, sizes are summed per (source, bin), bins are
prefix-summed, and rows are ordered only within their bin. The logarithm of an exponential key has a density of at most 1/e whatever the weight, so with R bins
a unit no bin holds more than 0.37 / R of its source: a source with a third of all rows is dealt over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.plans.scratch import stored

from .common import WORD

WEIGHTS = (5, 2, 1)


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def uniform(seed: int, *parts: Column) -> Column:
    """A number in (0, 1) from an md5 over the seed and the parts; null parts count as the text 'null'."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts])
    return (F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)


def quality(text: Column, size: Column) -> Column:
    """The sampling weight of a text: the share of its characters that are not symbols, squared; at least 0.01."""
    symbols = F.regexp_count(text, F.lit(r"[#*$%&|<>!]"))
    return F.coalesce(F.greatest(F.pow(1 - symbols / F.greatest(F.length(text), F.lit(1)), F.lit(2.0)), F.lit(0.01)), F.lit(0.01))


def _numbered(sizes: DataFrame) -> DataFrame:
    """sizes with `place`, its sources' place from 0 by code point, null last: sorted in ranges, numbered within them, ranges prefix-summed."""
    order = [F.col("source").isNull(), F.col("source")]
    dealt = stored(sizes.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "mix-sources")
    within = F.row_number().over(Window.partitionBy("part").orderBy(*order)) - 1
    each = dealt.groupBy("part").agg(F.count("*").alias("c"))  # a row for each range
    before = each.select(F.col("part").alias("p"), (F.sum("c").over(Window.orderBy("part")) - F.col("c")).alias("before"))
    return dealt.withColumn("within", within).join(before, F.col("part") == F.col("p")).withColumn("place", F.col("before") + F.col("within")).drop("part", "p", "before", "within")


def targets(sizes: DataFrame, *, weights: tuple[int, ...] = WEIGHTS, total: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size, target) from a table (source, size). A source is full when its weight times the share of a unit of weight reaches `most` times its
    size; taking the full ones out raises that share for the others, until no more are full. Each round is one sum, so sources can be many."""
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    rows = stored(_numbered(sizes).select("source", F.col("size").cast("long").alias("source_size"), weight.alias("weight")), "mix-targets")
    unit, full, n_full = 0.0, F.lit(False), 0
    while True:
        row = rows.agg(F.sum("source_size").alias("all"), F.sum(F.when(full, F.col("source_size"))).alias("used"), F.sum(F.when(~full, F.col("weight"))).alias("open"), F.count(F.when(full, 1)).alias("n")).first()
        if not row["open"] or unit and row["n"] == n_full:
            break
        unit, n_full = (total * row["all"] - most * (row["used"] or 0)) / row["open"], row["n"]
        full = F.col("weight") * F.lit(unit) >= most * F.col("source_size")
        if unit == 0:
            break
    given = F.when(full, most * F.col("source_size")).otherwise(F.col("weight") * F.lit(unit))
    return rows.select("source", "source_size", given.cast("double").alias("target"))


def plan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, total: float = 1.5, most: float = 2.0, seed: int = 11, rows_per_bin: int = 2_000, most_bins: int = 20_000) -> DataFrame:
    """One row for the rows that agree in id, source and text: (id, source, size, source_size, target, whole, copies, extra, text_key).

    There are `copies` such rows; each is taken `whole` times, and `extra` of them once more. Null or empty texts have size 0; null sources
    are a source. An empty table gives an empty plan. Bins are a matter of speed alone (see above): about rows_per_bin rows each, most_bins a unit at most.
    """
    text = F.col(text_col).cast("string")
    content = F.md5(F.coalesce(text, F.lit("")))
    base = docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), n_words(text).alias("size"), F.xxhash64(text).alias("text_key"), content.alias("content"), quality(text, F.lit(1)).alias("w"))
    base = base.groupBy("id", "source", "text_key").agg(F.first("size").alias("size"), F.first("w").alias("w"), F.first("content").alias("content"), F.count("*").alias("copies"))
    key = -F.ln(uniform(seed, F.col("id"), F.col("content"))) / F.col("w")
    base = stored(base.withColumn("key", key).drop("content", "w"), "mix-sizes")
    own = F.col("size") * F.col("copies")
    found = targets(base.groupBy("source").agg(F.sum(own).alias("size")), weights=weights, total=total, most=most)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("int")
    sources = found.withColumn("whole", whole).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size")).withColumnRenamed("source", "__s")
    bins = 1 + min(base.count() // rows_per_bin, most_bins)
    rows = base.withColumn("bin", F.floor(F.ln("key") * bins).cast("long"))
    per_bin = rows.groupBy("source", "bin").agg(F.sum(own).alias("bin_size"))
    before = per_bin.withColumn("before", F.sum("bin_size").over(Window.partitionBy("source").orderBy("bin")) - F.col("bin_size"))
    before = before.select(F.col("source").alias("__s"), F.col("bin").alias("__b"), "before")
    rows = rows.join(before, F.col("source").eqNullSafe(F.col("__s")) & (F.col("bin") == F.col("__b"))).drop("__s", "__b")
    inside = Window.partitionBy("source", "bin").orderBy("key", "id", "text_key")
    rows = rows.withColumn("start", F.col("before") + F.sum(own).over(inside) - own)
    rows = rows.join(sources, F.col("source").eqNullSafe(F.col("__s"))).drop("__s")
    # the k-th copy ends at start + k size, and goes in if that less half its size is within the rest
    fits = F.when(F.col("size") > 0, F.floor((F.col("rest") - F.col("start")) / F.col("size") + 0.5)).when(F.col("start") <= F.col("rest"), F.col("copies")).otherwise(0)
    extra = F.when((F.col("rest") > 0) & (F.col("whole") < int(most)), F.greatest(F.least(fits, F.col("copies")), F.lit(0))).otherwise(0).cast("long")
    return rows.select(F.col("id").alias(id_col), "source", "size", "source_size", "target", "whole", "copies", extra.alias("extra"), "text_key")


def mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """The mixture: every row as many times as it is taken; the columns stay as they are. Of repeated rows that are taken unequally (at most one group of a
    source is) the first ones of a stored order go once more; they differ in nothing that the plan reads."""
    found = stored(plan(docs, id_col=id_col, text_col=text_col, source_col=source_col, **how).where("whole > 0 or extra > 0"), "mix-plan")
    takes = found.select(F.col(id_col).alias("__mix_id"), F.col("source").alias("__mix_source"), F.col("text_key").alias("__mix_key"), (F.col("whole") + F.col("extra") / F.col("copies")).alias("__mix_n"), F.col("extra").alias("__mix_extra"))
    same = F.col(id_col).eqNullSafe(F.col("__mix_id")) & F.col(source_col).cast("string").eqNullSafe(F.col("__mix_source")) & (F.xxhash64(F.col(text_col).cast("string")) == F.col("__mix_key"))
    uneven = takes.where("__mix_n > floor(__mix_n)")
    copy = F.explode(F.sequence(F.lit(1), F.col("__mix_n").cast("int")))
    out = docs.join(takes.where("__mix_n = floor(__mix_n)"), same).withColumn("__mix_copy", copy).select([F.col(f"`{c}`") for c in docs.columns])
    if uneven.isEmpty():
        return out
    rows = stored(docs.join(uneven, same).withColumn("__mix_part", F.spark_partition_id()).withColumn("__mix_at", F.monotonically_increasing_id()), "mix-uneven")
    group = ["__mix_id", "__mix_source", "__mix_key"]
    counts = rows.groupBy(*group, "__mix_part").agg(F.count("*").alias("c"))
    before = counts.select(*[F.col(c).alias(f"{c}_") for c in [*group, "__mix_part"]], (F.sum("c").over(Window.partitionBy(*group).orderBy("__mix_part")) - F.col("c")).alias("__mix_before"))
    rows = rows.withColumn("__mix_rank", F.row_number().over(Window.partitionBy(*group, "__mix_part").orderBy("__mix_at")))
    rows = rows.join(before, [F.col(c).eqNullSafe(F.col(f"{c}_")) for c in [*group, "__mix_part"]])
    n = F.floor("__mix_n") + (F.col("__mix_before") + F.col("__mix_rank") <= F.col("__mix_extra")).cast("int")
    more = rows.withColumn("__mix_n", n).where("__mix_n > 0").withColumn("__mix_copy", copy).select([F.col(f"`{c}`") for c in docs.columns])
    return out.unionByName(more)
