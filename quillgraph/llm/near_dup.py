"""Near duplicates by MinHash, banding, odd sketches and an exact check on full shingle sets.

1. One pass over the texts: each document's number of distinct shingles, a 128-bit digest of its shingle set, band hashes
   of its MinHash samples, and its odd sketch: every sample sets the parity of one of 256 bits, so that the XOR of two
   sketches counts the samples that differ, and 1 + n/(4k) ln(1 - 2 |XOR|/n) estimates the similarity.
2. Documents with the same set form a class; only classes go on.
3. In each bucket of each band, all classes are compared with one of them, its centre (chosen by hash): a star, not all
   pairs. Pairs whose sizes or sketches rule the threshold out go; the others are confirmed on full sets.
4. Components of the confirmed links. What is left are pairs in one bucket and in different components. Of each bucket with several components,
   only the classes outside its largest one are compared with all others, in tiles of at most about `tile` classes a side, so a bucket of m classes of
   which r stand outside the largest component costs r m sketch comparisons, and sends r m / tile + m rows. Tiles see sketches alone. A tile with no more candidate pairs than
   rows gives these out, to be confirmed like the star's; of others the classes that have a candidate bring their full sets to a second pass over the
   same tiles, where candidates are confirmed in place and only links that connect something are given out. So every pair that shares a bucket is either
   already connected or was looked at: buckets have no cap, and what is listed grows with the rows. Many tiles share a task's batch, by a hash.

A pair of similarity s shares a bucket with probability 1 - (1 - s**rows)**bands (30 bands of 4 rows: 1 - 1.3e-7 at 0.8).
The sketch threshold lies `slack` below the wanted similarity, over five standard errors.

Null and empty texts have no shingles and link with nothing. Repeated rows and documents that share an id are members of
their texts' classes each. The component's id is the least id in it, ignoring nulls; other columns are not read, whatever their names. Texts of any length
are taken whole; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillgraph.operators.components import connected_components
from quillgraph.plans.scratch import stored

from .common import WORD, small_batches, text_bytes
from .shingles import mix, shingle_hashes

BITS = 256
_RNG = np.random.default_rng(77)
_XOR = _RNG.integers(0, 1 << 64, 1024, dtype=np.uint64)
_MULT = _RNG.integers(0, 1 << 63, 1024, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def distinct_sets(texts: list[bytes], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct shingle hashes, ascending, text after text, and their numbers."""
    hashes, count = shingle_hashes(texts, k)
    owner = np.repeat(np.arange(len(texts)), count)
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    keep = np.r_[True, (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])] if len(hashes) else np.zeros(0, bool)
    return hashes[keep], np.bincount(owner[keep], minlength=len(texts))


def sketches(hashes: np.ndarray, sizes: np.ndarray, bands: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Of sets with at least one element: band hashes [sets, bands], odd sketches [sets, BITS / 64]."""
    starts = np.cumsum(sizes) - sizes
    band = np.zeros((len(sizes), bands), np.uint64)
    odd = np.zeros((len(sizes), BITS // 64), np.uint64)
    which = np.arange(len(sizes))
    for j in range(bands * rows):
        least = np.minimum.reduceat((hashes ^ _XOR[j]) * _MULT[j], starts)
        band[:, j // rows] = mix(band[:, j // rows] * np.uint64(31) + least + np.uint64(j))
        bit = mix(least + _XOR[1023 - j]) % np.uint64(BITS)
        odd[which, (bit >> np.uint64(6)).astype(np.int64)] ^= np.uint64(1) << (bit & np.uint64(63))
    return band, odd


def odd_distance(similarity: float, samples: int) -> float:
    """The expected XOR population count at a similarity, from the estimate's formula."""
    return BITS / 2 * (1 - np.exp(4 * samples / BITS * (similarity - 1)))


def _sketch(k: int, bands: int, rows: int, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in small_batches(whole, "text", 1 << 20):
                hashes, sizes = distinct_sets(text_bytes(batch.column("text")), k)
                full = np.flatnonzero(sizes)
                starts = np.cumsum(sizes) - sizes
                digest, band_rows, odd_rows = [None] * len(sizes), [None] * len(sizes), [None] * len(sizes)
                if len(full):
                    band, odd = sketches(hashes, sizes[full], bands, rows)
                    for i, b, o in zip(full, band.view(np.int64), odd.view(np.int64), strict=True):
                        digest[i] = hashlib.blake2b(hashes[starts[i] : starts[i] + sizes[i]].tobytes(), digest_size=16).digest()
                        band_rows[i], odd_rows[i] = b, o
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id"), batch.column("text_key"), pa.array(sizes, pa.int64()), pa.array(digest, pa.binary()), pa.array(band_rows, pa.list_(pa.int64())), pa.array(odd_rows, pa.list_(pa.int64()))],
                    schema=schema,
                )

    return run


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in small_batches(whole, "text", 1 << 20):
                hashes, sizes = distinct_sets(text_bytes(batch.column("text")), k)
                ends = np.r_[0, np.cumsum(sizes)].astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column("digest"), pa.ListArray.from_arrays(pa.array(ends), pa.array(hashes.view(np.int64)))], ["digest", "shingles"])

    return run


def _exact_links(candidates, sets: list[np.ndarray], label: np.ndarray, threshold_pct: int) -> list[tuple[int, int]]:
    """Links among candidate pairs (row, rows) confirmed on full sets; pairs already connected in this tile are left out, so there
    are fewer links than rows."""
    sizes = np.array([len(x) for x in sets], np.int64)
    values, coded = np.unique(np.concatenate(sets), return_inverse=True)
    ends = np.cumsum(sizes)
    present = np.zeros(len(values), bool)
    links = []
    for i, others in candidates:
        others = others[label[others] != label[i]]
        if not len(others):
            continue
        own = coded[ends[i] - sizes[i] : ends[i]]
        present[own] = True
        n = sizes[others]
        at = np.arange(n.sum()) + np.repeat(ends[others] - np.cumsum(n), n)
        shared = np.add.reduceat(present[coded[at]].astype(np.int64), np.cumsum(n) - n)
        present[own] = False
        for j in others[shared * 100 >= (sizes[i] + n - shared) * threshold_pct]:
            if label[j] != label[i]:
                links.append((i, j))
                label[label == label[j]] = label[i]
    return links


class _Tiles:
    """The tiles of a batch: rows in order of (band, hash, low, high, side), and where each tile begins."""

    KEYS = ("band", "hash", "low", "high")

    def __init__(self, table: pa.Table):
        keys = [table[c].to_numpy() for c in ("side", *reversed(self.KEYS))]
        self.order = np.lexsort(keys)
        same = [k[self.order] for k in keys[1:]]
        new = np.ones(len(self.order), bool)
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in same])
        self.starts = np.flatnonzero(new)
        self.ends = np.r_[self.starts[1:], len(self.order)]
        self.side, self.n, self.label = (table[c].to_numpy()[self.order] for c in ("side", "n", "label"))
        self.odd = np.stack([table[f"o{i}"].to_numpy()[self.order] for i in range(BITS // 64)], axis=1).view(np.uint64)

    def pairs(self, a: int, b: int, threshold_pct: int, most_odd: float) -> Iterator[tuple[int, np.ndarray]]:
        """Of the tile at rows a to b: (row, rows), pairs of different components that sizes and sketches don't rule out. A tile with one side is
        compared with itself."""
        cut = a + int(np.searchsorted(self.side[a:b], 1))
        right = np.arange(cut, b)
        for i in range(a, cut):
            others = right if cut < b else np.arange(i + 1, b)
            others = others[(self.label[others] != self.label[i]) & (np.minimum(self.n[i], self.n[others]) * 100 >= threshold_pct * np.maximum(self.n[i], self.n[others]))]
            others = others[np.bitwise_count(self.odd[others] ^ self.odd[i]).sum(axis=1) <= most_odd]
            if len(others):
                yield i, others


def _candidates(threshold_pct: int, most_odd: float):
    """Of a batch of tiles: a tile's candidate pairs (digest, other), if they are no more than its rows; else its rows that have a candidate, with other
    null, for the second pass. So what is given out grows with the rows."""

    def run(table: pa.Table) -> pa.Table:
        tiles = _Tiles(table)
        left, right, hit = [], [], np.zeros(table.num_rows, bool)
        for a, b in zip(tiles.starts, tiles.ends, strict=True):
            found = list(tiles.pairs(a, b, threshold_pct, most_odd))
            if sum(len(others) for _, others in found) <= b - a:
                for i, others in found:
                    left.append(np.full(len(others), i))
                    right.append(others)
            else:
                for i, others in found:
                    hit[i] = hit[others] = True
        pick = lambda at: tiles.order[np.concatenate(at) if at else np.zeros(0, np.int64)]
        pairs = table.take(pa.array(pick(left))).append_column("other", table["digest"].take(pa.array(pick(right))))
        rows = table.take(pa.array(tiles.order[hit]))
        return pa.concat_tables([pairs, rows.append_column("other", pa.nulls(rows.num_rows, pa.binary()))])

    return run


def _confirmed(threshold_pct: int, most_odd: float):
    """Of a batch of tiles whose rows bring their full sets: confirmed links, as many as connect each tile."""

    def run(table: pa.Table) -> pa.Table:
        tiles = _Tiles(table)
        table = table.take(pa.array(tiles.order))
        digest, sets = table["digest"].to_pylist(), [np.asarray(x.values) for x in table["shingles"].combine_chunks()]
        links = []
        for a, b in zip(tiles.starts, tiles.ends, strict=True):
            found = [(i - a, others - a) for i, others in tiles.pairs(a, b, threshold_pct, most_odd)]
            if found:
                links += [(a + i, a + j) for i, j in _exact_links(found, sets[a:b], np.unique(tiles.label[a:b], return_inverse=True)[1], threshold_pct)]
        return pa.table({"a": pa.array([min(digest[i], digest[j]) for i, j in links], pa.binary()), "b": pa.array([max(digest[i], digest[j]) for i, j in links], pa.binary())})

    return run


def tiles(split: DataFrame, tile: int) -> DataFrame:
    """(band, hash, low, high, side, digest, label): the rows of the tiles that compare, in each bucket (band, hash) of `split` (band, hash, digest, label) with
    several labels, the classes outside its most frequent label with all others of another label. low and high name the two sides' tiles, with high counted
    from -1 downwards for tiles of the most frequent label; a tile of others with itself has side 0 only."""
    per = split.groupBy("band", "hash", "label").agg(F.count("*").alias("c"))
    facts = per.groupBy("band", "hash").agg(F.max(F.struct("c", "label")).alias("main"), F.sum("c").alias("m"), F.count("*").alias("labels")).where("labels > 1")
    facts = facts.select("band", "hash", F.col("main.label").alias("main"), F.ceil(F.col("main.c") / tile).cast("int").alias("n_main"), F.ceil((F.col("m") - F.col("main.c")) / tile).cast("int").alias("n_rest"))
    rows = split.join(facts, ["band", "hash"]).withColumn("is_main", F.col("label") == F.col("main"))
    own = F.pmod(F.xxhash64("digest", F.lit(1)), F.when(F.col("is_main"), F.col("n_main")).otherwise(F.col("n_rest"))).cast("int")
    at = lambda low, high, side: F.struct(low.cast("int").alias("low"), high.cast("int").alias("high"), F.lit(side).cast("int").alias("side"))
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    as_main = F.transform(upto("n_rest"), lambda j: at(j, -1 - F.col("own"), 1))
    against_main = F.transform(upto("n_main"), lambda j: at(F.col("own"), -1 - j, 0))
    as_rest = F.transform(upto("n_rest"), lambda j: F.when(F.col("own") <= j, at(F.col("own"), j, 0)).otherwise(at(j, F.col("own"), 1)))
    rows = rows.withColumn("own", own).withColumn("x", F.explode(F.when(F.col("is_main"), as_main).otherwise(F.concat(against_main, as_rest))))
    return rows.select("band", "hash", "x.low", "x.high", "x.side", "digest", "label")


def _ruled_in(pairs: DataFrame, classes: DataFrame, threshold_pct: int, most_odd: float) -> DataFrame:
    """The pairs whose sizes and sketches allow the similarity."""
    facts = classes.select("digest", "n", "odd")
    both = pairs.join(facts.select(F.col("digest").alias("a"), F.col("n").alias("na"), F.col("odd").alias("oa")), "a").join(facts.select(F.col("digest").alias("b"), F.col("n").alias("nb"), F.col("odd").alias("ob")), "b")
    apart = sum((F.bit_count(F.col("oa")[i].bitwiseXOR(F.col("ob")[i])) for i in range(BITS // 64)), F.lit(0))
    return both.where((F.least("na", "nb") * 100 >= F.greatest("na", "nb") * threshold_pct) & (apart <= most_odd)).select("a", "b", "na", "nb")


def _full_sets(wanted: DataFrame, classes: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """(digest, shingles) of the wanted classes, from one text of each."""
    wanted = classes.join(wanted, "digest", "left_semi").select("digest", F.col("one.id").alias("wid"), F.col("one.text_key").alias("wkey"))
    texts = rows.join(wanted, rows["id"].eqNullSafe(wanted["wid"]) & (rows["text_key"] == wanted["wkey"])).select("digest", "text")
    return stored(texts.mapInArrow(_sets(k), "digest binary, shingles array<long>"), "shingle-sets").dropDuplicates(["digest"])


def _confirm(pairs: DataFrame, sets: DataFrame, threshold_pct: int) -> DataFrame:
    """The pairs (a, b, na, nb) whose full sets have the similarity."""
    both = pairs.join(sets.select(F.col("digest").alias("a"), F.col("shingles").alias("sa")), "a").join(sets.select(F.col("digest").alias("b"), F.col("shingles").alias("sb")), "b")
    shared = F.size(F.array_intersect("sa", "sb"))
    return both.where(shared * 100 >= (F.col("na") + F.col("nb") - shared) * threshold_pct).select("a", "b")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, threshold_pct: int = 80, bands: int = 30, rows_per_band: int = 4, slack: float = 0.2, tile: int = 512, batch: int = 1024) -> DataFrame:
    """One row per document: (id, n_shingles, component_id, kept, class_id, component_key, text_key).

    Documents are linked when 100 * |intersection| >= threshold_pct * |union| of their sets of distinct `shingle`-word shingles.
    component_id is the least id that can be reached, its own for a document without words; kept is id = component_id.
    class_id is the least id with the same set; component_key names the component (null without words).
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).withColumn("text_key", F.xxhash64("text"))
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = T.StructType([rows.schema["id"], rows.schema["text_key"], *T._parse_datatype_string("n long, digest binary, bands array<long>, odd array<long>").fields])
    arrow = pa.schema([pa.field(f.name, f.type) for f in to_arrow_schema(schema)])
    found = stored(rows.mapInArrow(_sketch(shingle, bands, rows_per_band, arrow), schema), "sketches")
    full = found.where("n > 0")
    classes = stored(full.groupBy("digest").agg(F.min(F.struct("id", "text_key")).alias("one"), F.min("id").alias("class_id"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("odd").alias("odd")), "classes")

    most_odd = odd_distance(threshold_pct / 100 - slack, bands * rows_per_band)
    bucket = classes.select("digest", F.posexplode("bands").alias("band", "hash"))
    centre = bucket.groupBy("band", "hash").agg(F.count("*").alias("members"), F.min(F.struct(F.xxhash64("digest", "band"), "digest")).alias("centre")).where("members > 1").select("band", "hash", "members", F.col("centre.digest").alias("centre"))
    shared = stored(bucket.join(centre, ["band", "hash"]), "buckets")
    star = shared.where("digest <> centre").select(F.least("digest", "centre").alias("a"), F.greatest("digest", "centre").alias("b")).distinct()
    star = stored(_ruled_in(star, classes, threshold_pct, most_odd), "star")
    sets = _full_sets(shared.select("digest").distinct(), classes, rows, shingle)
    links = stored(_confirm(star, sets, threshold_pct), "links")

    labels = stored(connected_components(links, "a", "b"), "labels")
    rest = tiles(_bucket_components(shared, labels), tile).join(classes.select("digest", F.col("n").cast("long").alias("n"), "odd"), "digest")
    rest = rest.withColumn("label", F.xxhash64("label")).select("band", "hash", "low", "high", "side", "digest", "label", "n", *[F.col("odd")[i].alias(f"o{i}") for i in range(BITS // 64)])
    rest = stored(rest, "tiles")
    batched = lambda df, n: df.groupBy(F.pmod(F.xxhash64("band", "hash", "low", "high"), F.lit(n)).alias("batch"))
    schema = T.StructType([*rest.schema.fields, T.StructField("other", T.BinaryType())])
    hits = stored(batched(rest, 1 + rest.count() // batch).applyInArrow(_candidates(threshold_pct, most_odd), schema), "tile-candidates")
    pairs = hits.where("other is not null").select(F.least("digest", "other").alias("a"), F.greatest("digest", "other").alias("b")).distinct().join(star.select("a", "b"), ["a", "b"], "left_anti")
    found_links = _confirm(_ruled_in(pairs, classes, threshold_pct, most_odd), sets, threshold_pct)
    weight = hits.where("other is null").agg(F.sum("n")).first()[0]
    if weight:
        full_rows = hits.where("other is null").drop("other").join(sets.select("digest", "shingles"), "digest")
        found_links = found_links.unionByName(batched(full_rows, 1 + weight // (256 * batch)).applyInArrow(_confirmed(threshold_pct, most_odd), "a binary, b binary"))
    more = stored(found_links.distinct(), "tile-links")
    if not more.isEmpty():
        labels = connected_components(links.unionByName(more), "a", "b")

    named = _label(classes.select("digest", "class_id"), labels)
    least = named.groupBy("label").agg(F.min("class_id").alias("component_id"))
    named = named.join(least, "label").select("digest", "class_id", "component_id", F.hex("label").alias("component_key"))
    out = found.select("id", "text_key", F.col("n").alias("n_shingles"), F.coalesce("digest", F.xxhash64("id").cast("string").cast("binary")).alias("digest")).join(named, "digest", "left")
    own = F.col("component_key").isNull()
    component: Column = F.when(own, F.col("id")).otherwise(F.col("component_id"))
    return out.select(F.col("id").alias(id_col), "n_shingles", component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"), F.when(own, F.col("id")).otherwise(F.col("class_id")).alias("class_id"), "component_key", "text_key")


def _label(nodes: DataFrame, labels: DataFrame) -> DataFrame:
    return nodes.join(labels.withColumnRenamed("node", "digest"), "digest", "left").withColumn("label", F.coalesce("component", "digest")).drop("component")


def _bucket_components(shared: DataFrame, labels: DataFrame) -> DataFrame:
    """Members of shared buckets with their components."""
    return _label(shared.select("band", "hash", "digest"), labels)


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, threshold_pct: int = 80) -> DataFrame:
    """The documents without near copies: of each component the one with the least id stays, and all rows without words.

    Where several rows of a component have that id (repeated rows, or rows without ids), one of them stays.
    """
    found = stored(near_duplicates(docs, id_col=id_col, text_col=text_col, shingle=shingle, threshold_pct=threshold_pct), "near-dup")
    rows = found.where("kept and component_key is not null").groupBy("component_key", F.col(id_col).alias("id"), "text_key").agg(F.count("*").alias("n"))
    one = rows.groupBy("component_key").agg(F.min(F.struct("id", "text_key", "n")).alias("one"))
    keys = stored(one.select(F.col("one.id").alias("__nd_id"), F.col("one.text_key").alias("__nd_key"), F.col("one.n").alias("__nd_n")), "kept")
    words = F.coalesce(docs[text_col].cast("string"), F.lit("")).rlike(WORD)
    marked = docs.withColumn("__nd_words", words).withColumn("__nd_text", F.xxhash64(F.col(text_col).cast("string")))
    kept = marked.join(keys, F.col(id_col).eqNullSafe(F.col("__nd_id")) & (F.col("__nd_text") == F.col("__nd_key")) & F.col("__nd_words"), "left").where("not __nd_words or __nd_n is not null")
    if keys.where("__nd_n > 1").isEmpty():
        return kept.select(docs.columns)
    once = kept.where("not __nd_words or __nd_n = 1").select(docs.columns)
    return once.unionByName(kept.where("__nd_words and __nd_n > 1").dropDuplicates([id_col, "__nd_text"]).select(docs.columns))
