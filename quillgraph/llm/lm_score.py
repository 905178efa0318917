"""Language-model scoring: context-tree weighting over bytes, learned from the whole training part of a corpus.

The coded text is the document's lower-cased (A-Z) words, each followed by a space, then one end byte; so a score is the
log10 probability of the document's sequence of words and end, comparable with the unigram base beside it.

How it runs. (1) Each scan task packs its documents into blocks of `block_bytes`; a block holds its documents, its
distinct grams and its distinct words with their training counts, the two latter dealt over parts by a hash. They are
written once to the shared folder. (2) Grams are dealt by their `cut` bytes of context, so even " the" is a small share of a part.
Per part, the grams of all blocks are merged and the subtrees below depth `cut` weighed bottom-up. Their sums are written, dealt by
`root` bytes of context, and the storey between the cuts weighed likewise, of which a context has at most 256**(cut - root) rows a byte;
its sums, at most 256**root rows, meet in the driver, which weighs the tree's crown. (3) Top-down, the crown's answers go to the storey,
the storey's to the parts that hold its rows, and every gram's log probability to just the blocks that hold that gram.
(4) Each block scores its documents with what it got. No table that grows with the corpus is broadcast or collected;
a task holds one block, one part of the grams, or one part of the storey.

Null and empty texts have one token, the end. Repeated rows are scored each; a document's id only decides its part in
training. Without training rows every byte costs what the untrained tree gives. Columns other than id and text are ignored, whatever their names. Texts of any
length are scored whole; an empty table gives an empty result. There are no ties to break: a score depends on the text and the training rows alone.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillgraph.plans.scratch import scratch

from . import ctw
from .common import of_hash, pack, small_batches, text_bytes, unpack

END = b"\n"
UNKNOWN = -1.0  # log10(0 + 0.1)
SLICE = 2 << 20
_BLOCKS = "block string, part int, kind string, payload binary"
_SUMS = "kind string, origin int, part int, payload binary"


class Lookup:
    """Open-addressed table from uint64 keys to values; every key asked for is present."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(2 * max(1, len(keys)) - 1).bit_length())
        self.keys, self.values, self.slots = keys, values, np.full(1 << self.bits, -1, np.int32)
        rest, at = np.arange(len(keys), dtype=np.int32), self._start(keys)
        while len(rest):
            free = self.slots[at] < 0
            self.slots[at[free]] = rest[free]
            lost = self.slots[at] != rest
            rest, at = rest[lost], (at[lost] + 1) & (len(self.slots) - 1)

    def _start(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, asked: np.ndarray) -> np.ndarray:
        at = self._start(asked)
        found = self.slots[at]
        wrong = np.flatnonzero(self.keys[found] != asked)
        at = at[wrong]
        while len(wrong):
            at = (at + 1) & (len(self.slots) - 1)
            found[wrong] = self.slots[at]
            bad = self.keys[found[wrong]] != asked[wrong]
            wrong, at = wrong[bad], at[bad]
        return self.values[found]


def _coded(texts: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Grams of coded texts one after another, and the number of grams of each."""
    pad = b"\0" * depth
    flat = np.frombuffer(b"".join([pad + x for x in texts]), np.uint8)
    sizes = np.array([len(x) for x in texts], np.int64)
    starts = np.cumsum(sizes + depth) - sizes - depth
    keep = np.ones(len(flat), bool)
    keep[(starts[:, None] + np.arange(depth)).ravel()] = False
    return ctw.grams(flat, depth)[keep], sizes


def _gram_part(keys: np.ndarray, length: int, parts: int) -> np.ndarray:
    context = (keys >> np.uint64(8)) & ctw.mask(length - 1)
    return (((context * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)) % np.uint64(parts)).astype(np.int64)


def _keys_table(keys: np.ndarray, **columns: np.ndarray) -> pa.Table:
    return pa.table({"gap": np.diff(keys, prepend=np.uint64(0)), **columns})


def _keys(table: pa.Table) -> np.ndarray:
    return np.cumsum(table["gap"].to_numpy(), dtype=np.uint64)


class _Block:
    """Documents of one block with their distinct grams and words."""

    def __init__(self, depth: int, cut: int, parts: int):
        self.depth, self.cut, self.parts = depth, cut, parts
        self.rows: list[pa.Table] = []
        self.grams: list[tuple[np.ndarray, np.ndarray]] = []
        self.words: Counter = Counter()
        self.size = 0

    def add(self, ids: pa.Array, held: list[bool], texts: list[bytes]) -> None:
        for a in range(0, len(texts), 256):
            self._slice(ids.slice(a, 256), held[a : a + 256], texts[a : a + 256])

    def _slice(self, ids: pa.Array, held: list[bool], texts: list[bytes]) -> None:
        coded: list[bytes] = []
        for out, text in zip(held, texts, strict=True):
            tokens = text.lower().split()
            coded.append(b" ".join([*tokens, END]))
            if out:
                for w in {*tokens, END}:
                    if w not in self.words:
                        self.words[w] = 0
            else:
                self.words.update(tokens)
                self.words[END] += 1
        self.size += sum(map(len, coded))
        for out in (False, True):
            for some in _runs([x for x, h in zip(coded, held, strict=True) if h == out]):
                keys = _coded(some, self.depth)[0]
                keys.sort()
                first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
                n = np.diff(np.r_[first, len(keys)])
                self.grams.append((keys[first], np.zeros_like(n) if out else n))
        if len(self.grams) > 8:
            self.grams = [ctw.merged(*map(np.concatenate, zip(*self.grams, strict=True)))]
        # the ids are copied, since a slice would keep its whole batch
        self.rows.append(pa.table({"id": pa.array(ids.to_pylist(), ids.type), "held": pa.array(held, pa.bool_()), "coded": pa.array(coded, pa.large_binary())}))

    def emit(self, name: str) -> Iterator[pa.RecordBatch]:
        def row(part: int, kind: str, table: pa.Table) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([part], pa.int32()), pa.array([kind]), pa.array([pack(table)], pa.binary())], ["block", "part", "kind", "payload"])

        rows, self.rows = self.rows, []
        yield row(-1, "documents", pa.concat_tables(rows).combine_chunks())
        del rows
        keys, counts = ctw.merged(*map(np.concatenate, zip(*self.grams, strict=True)))
        self.grams = []
        part = _gram_part(keys, self.cut, self.parts)
        order = np.argsort(part, kind="stable")
        ends = np.searchsorted(part[order], np.arange(self.parts + 1))
        for p in np.flatnonzero(np.diff(ends)):
            own = order[ends[p] : ends[p + 1]]
            yield row(p, "grams", _keys_table(keys[own], n=counts[own]))
        dealt: dict[int, list[bytes]] = {}
        for w in self.words:
            dealt.setdefault(of_hash(w, self.parts), []).append(w)
        for p, words in sorted(dealt.items()):
            words.sort()
            yield row(p, "words", pa.table({"word": pa.array(words, pa.binary()), "n": pa.array([self.words[w] for w in words], pa.int64())}))


def _runs(texts: list[bytes]) -> Iterator[list[bytes]]:
    some, size = [], 0
    for x in texts:
        some.append(x)
        size += len(x)
        if size >= SLICE:
            yield some
            some, size = [], 0
    if some:
        yield some


def _make_blocks(depth: int, cut: int, parts: int, block_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, block, n = TaskContext.get().partitionId(), _Block(depth, cut, parts), 0
        for whole in batches:
            for batch in small_batches(whole, "text", SLICE):
                texts, held, a, size = text_bytes(batch.column("text")), batch.column("held").to_pylist(), 0, 0
                for b, x in enumerate(texts, 1):
                    size += len(x)
                    if b == len(texts) or block.size + size >= block_bytes:
                        block.add(batch.column("id").slice(a, b - a), held[a:b], texts[a:b])
                        a, size = b, 0
                    if block.size >= block_bytes:
                        yield from block.emit(f"{task}-{n}")
                        block, n = _Block(depth, cut, parts), n + 1
        if block.rows:
            yield from block.emit(f"{task}-{n}")

    return run


def _all_grams(payloads: list[bytes]):
    """The distinct grams of a part with their training counts, and each payload's keys."""
    tables = [unpack(x) for x in payloads]
    own = [_keys(t) for t in tables]
    return *ctw.merged(np.concatenate(own), np.concatenate([t["n"].to_numpy() for t in tables])), own


def _word_counts(payloads: list[bytes]) -> tuple[Counter, list[list[bytes]]]:
    counts: Counter = Counter()
    own = []
    for table in map(unpack, payloads):
        words = table["word"].to_pylist()
        own.append(words)
        for w, n in zip(words, table["n"].to_pylist(), strict=True):
            counts[w] += n
    return counts, own


def _summed(payloads: list[bytes]):
    """Rows of a cut with their counts and eight sums, those of all payloads added up, and each payload's rows."""
    tables = [unpack(x) for x in payloads]
    columns = [c for c in tables[0].column_names if c != "row"]
    found = pa.concat_tables(tables).group_by("row").aggregate([(c, "sum") for c in columns]).sort_by("row")
    return found["row"].to_numpy(), found["n_sum"].to_numpy(), np.array([found[f"s{i}_sum"].to_numpy() for i in range(8)]), [t["row"].to_numpy() for t in tables]


def _sums_table(rows: np.ndarray, n: np.ndarray, sums: np.ndarray) -> pa.Table:
    return pa.table({"row": rows, "n": n, **{f"s{i}": sums[i] for i in range(8)}})


def _sum_part(depth: int, cut: int, root: int, middles: int):
    """A part's sums at the lower cut, dealt over the storey's parts; of words the number and the distinct ones."""

    def run(table: pa.Table) -> pa.Table:
        kind, origin, payloads = table["kind"][0].as_py(), table["part"][0].as_py(), table["payload"].to_pylist()
        if kind == "grams":
            keys, counts, _ = _all_grams(payloads)
            rows, n, sums = ctw.subtree_sums(keys, counts, depth, cut)
            part = _gram_part(rows, root, middles)
            found = {p: _sums_table(rows[part == p], n[part == p], sums[:, part == p]) for p in np.unique(part).tolist()}
        else:
            counts, _ = _word_counts(payloads)
            found = {origin % middles: pa.table({"total": [sum(counts.values())], "distinct": [sum(n > 0 for n in counts.values())]})}
        return pa.table({"kind": [kind] * len(found), "origin": pa.array([origin] * len(found), pa.int32()), "part": pa.array(found, pa.int32()), "payload": pa.array(map(pack, found.values()), pa.binary())})

    return run


def _storey_sums(cut: int, root: int):
    def run(table: pa.Table) -> pa.Table:
        kind, part, payloads = table["kind"][0].as_py(), table["part"][0].as_py(), table["payload"].to_pylist()
        if kind == "grams":
            rows, n, sums, _ = _summed(payloads)
            found = _sums_table(*ctw.subtree_sums(rows, n, cut - 1, root, sums))
        else:
            found = pa.concat_tables(map(unpack, payloads))
        return pa.table({"kind": [kind], "part": pa.array([part % 32], pa.int32()), "payload": pa.array([pack(found)], pa.binary())})

    return run


def _join_sums(table: pa.Table) -> pa.Table:
    kind, part, payloads = table["kind"][0].as_py(), table["part"][0].as_py(), table["payload"].to_pylist()
    if kind == "grams":
        found = _sums_table(*_summed(payloads)[:3])
    else:
        found = pa.concat_tables(map(unpack, payloads))
        found = pa.table({c: [sum(found[c].to_pylist())] for c in found.column_names})
    return pa.table({"kind": [kind], "part": pa.array([part], pa.int32()), "payload": pa.array([pack(found)], pa.binary())})


def _answer_storey(cut: int, root: int, above: np.ndarray, top: np.ndarray):
    """For each part that holds rows of the storey, what the depths above the lower cut give for them."""

    def run(table: pa.Table) -> pa.Table:
        rows, n, sums, own = _summed(table["payload"].to_pylist())
        given = ctw.storey(rows, n, sums, cut - 1, root, above, top).reshape(24, -1).astype(np.float32)
        answers = []
        for some in own:
            at = np.searchsorted(rows, some)
            answers.append(pack(pa.table({"row": some, **{f"a{i}": given[i, at] for i in range(24)}})))
        return pa.table({"kind": table["kind"], "part": table["origin"], "payload": pa.array(answers, pa.binary())})

    return run


def _answer_part(depth: int, cut: int):
    def run(table: pa.Table, told: pa.Table) -> pa.Table:
        kind, payloads = table["kind"][0].as_py(), table["payload"].to_pylist()
        if kind == "grams":
            keys, counts, own = _all_grams(payloads)
            above = pa.concat_tables(map(unpack, told["payload"].to_pylist())).sort_by("row")
            top = np.array([above[f"a{i}"].to_numpy() for i in range(24)], float).reshape(3, 8, -1)
            scores = ctw.gram_scores(keys, counts, depth, cut, above["row"].to_numpy(), top).astype(np.float32)
            answers = [pack(_keys_table(x, score=scores[np.searchsorted(keys, x)])) for x in own]
        else:
            counts, own = _word_counts(payloads)
            answers = [pack(pa.table({"word": pa.array(words, pa.binary()), "n": pa.array([counts[w] for w in words], pa.int64())})) for words in own]
        return pa.table({"block": table["block"], "kind": table["kind"], "payload": pa.array(answers, pa.binary())})

    return run


def _score_block(depth: int, total: int, distinct: int, schema: pa.Schema):
    spread = math.log10(total + 0.1 * (distinct + 1))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return schema.empty_table()
        told = {"grams": [], "words": []}
        for kind, payload in zip(right["kind"].to_pylist(), right["payload"].to_pylist(), strict=True):
            told[kind].append(unpack(payload))
        look_up = Lookup(np.concatenate([_keys(t) for t in told["grams"]]), np.concatenate([t["score"].to_numpy() for t in told["grams"]]))
        log_count = {}
        for t in told.pop("words"):
            for w, n in zip(t["word"].to_pylist(), t["n"].to_pylist(), strict=True):
                log_count[w] = math.log10(n + 0.1) if n else UNKNOWN
        docs = unpack(left["payload"][0].as_py())
        scores, sizes, n_tokens, n_known, base = [], [], [], [], []
        coded = docs["coded"].to_pylist()
        for some in _runs(coded):
            keys, size = _coded(some, depth)
            scores.append(np.add.reduceat(look_up(keys).astype(float), np.cumsum(size) - size))
            sizes.append(size)
            for x in some:
                logs = list(map(log_count.__getitem__, [*x.split(), END]))
                n_tokens.append(len(logs))
                n_known.append(len(logs) - logs.count(UNKNOWN))
                base.append(sum(logs) - len(logs) * spread)
        score, n_bytes = np.concatenate(scores), np.concatenate(sizes)
        return pa.Table.from_arrays(
            [docs["id"], docs["held"], pa.array(n_tokens, pa.int64()), pa.array(n_known, pa.int64()), pa.array([total] * len(coded), pa.int64()), pa.array(base, pa.float64()), pa.array(score), pa.array(n_bytes), pa.array(-score / np.log10(2) / n_bytes)],
            schema=schema,
        )

    return run


def score_documents(docs: DataFrame, held_out: Column, *, id_col: str = "doc_id", text_col: str = "text", depth: int = 5, cut: int = 4, root: int = 2, block_bytes: int = 16 << 20) -> DataFrame:
    """Learn from the rows that held_out does not mark, and score all of them.

    Returns (id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte): base_score is the smoothed
    unigram's log10 probability, score the context-tree model's. depth is the longest context in bytes (3 to 7), root < cut <= depth
    where the tree is cut (a cut beyond the depth is moved there; results do not depend on it), and block_bytes of coded text bound what one task holds.
    """
    cut = min(cut, depth)
    if not 0 < root < cut <= depth <= 7:
        raise ValueError("0 < root < cut <= depth <= 7 must hold")
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(held_out, F.lit(False)).alias("held"), F.col(text_col).cast("string").alias("text"))
    total_bytes = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = 1 + total_bytes // block_bytes
    middles = 1 + parts // 16
    path = scratch(spark, "ctw-blocks")
    rows.mapInArrow(_make_blocks(depth, cut, parts, block_bytes), _BLOCKS).write.parquet(path)
    blocks = spark.read.schema(_BLOCKS).parquet(path)
    dealt = blocks.where("kind <> 'documents'")
    path = scratch(spark, "ctw-sums")
    dealt.groupBy("kind", "part").applyInArrow(_sum_part(depth, cut, root, middles), _SUMS).write.parquet(path)
    lower = spark.read.schema(_SUMS).parquet(path)
    sums = lower.groupBy("kind", "part").applyInArrow(_storey_sums(cut, root), "kind string, part int, payload binary")
    sums = sums.groupBy("kind", "part").applyInArrow(_join_sums, "kind string, part int, payload binary").collect()  # at most 64 rows of 256**root
    schema = T.StructType([T.StructField(id_col, rows.schema["id"].dataType), *T._parse_datatype_string("held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_bytes long, bits_per_byte double").fields])
    if not sums:
        return spark.createDataFrame([], schema)
    crown_rows, n, at_crown, _ = _summed([r.payload for r in sums if r.kind == "grams"])
    top = ctw.crown(crown_rows, n, at_crown, root)
    words = pa.concat_tables([unpack(r.payload) for r in sums if r.kind == "words"])
    total, distinct = (sum(words[c].to_pylist()) for c in ("total", "distinct"))
    told = lower.where("kind = 'grams'").groupBy("part").applyInArrow(_answer_storey(cut, root, crown_rows, top), "kind string, part int, payload binary")
    answers = dealt.groupBy("kind", "part").cogroup(told.groupBy("kind", "part")).applyInArrow(_answer_part(depth, cut), "block string, kind string, payload binary")
    from pyspark.sql.pandas.types import to_arrow_schema

    documents = blocks.where("kind = 'documents'").select("block", "payload")
    return documents.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_score_block(depth, total, distinct, to_arrow_schema(schema)), schema)
