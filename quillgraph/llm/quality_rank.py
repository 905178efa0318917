"""Quality classification by Bradley-Terry pairwise ranking.

Each document is a vector of text statistics. Preference pairs, a document labelled good before one labelled bad, give differences of
vectors; the logistic loss on these differences is minimised, so w.x is the document's Bradley-Terry score. The
threshold is the quantile of the (class-weighted) sample's scores at the share of bad documents; the reported score is the
logistic of the distance from it, so 0.5 is the threshold.

fit() learns from a bounded sample (`per_class` rows a class) and draws pairs from it. fit_all() learns from all training rows and all pairs of a good and a bad
one: a row's pull on the weights depends on its score alone, so the classes' sums by bins of the score stand for all pairs, and each Newton step is two
aggregations; the threshold is the exact quantile of all training scores. Scoring is one narrow pass over all whole texts, or over their vectors().
Null and empty texts have the statistics of no words. Without labels of both classes every score is 1 or 0 as the
only class says, 0.5 without any. Repeated rows are scored alike, very long texts whole; an empty table gives an empty result. Equal scores at the quantile: the
threshold lies midway to the next one in order, so scores that tie there fall on one side together. Of columns other than id and text none is read, whatever
their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.plans.scratch import stored

from .common import small_batches, text_bytes
from .labelled import classes, logistic, sample
from .shingles import WORD_BYTE, word_hashes


def _class(text: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(text.encode())] = True
    return out


_CAPITAL, _SYMBOL, _DIGIT = _class("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _class("#*$%&<>@^~_+=\\"), _class("0123456789")
_BANG, _PIPE, _STOP, _LINE, _HIGH = _class("!?"), _class("|"), _class(".,;:"), _class("\n"), np.arange(256) >= 0xC0
_CLASSES = (_CAPITAL, _SYMBOL, _DIGIT, _BANG, _PIPE, _STOP, _LINE, _HIGH)


def _repeats(hashes: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Of each run of hashes, how many equal an earlier one."""
    owner = np.repeat(np.arange(len(n)), n)
    order = np.lexsort((hashes, owner))
    h, o = hashes[order], owner[order]
    again = (h[1:] == h[:-1]) & (o[1:] == o[:-1])
    return np.bincount(o[1:][again], minlength=len(n))


def features(texts: list[bytes]) -> np.ndarray:
    """Statistics [texts, features]: shares as square roots, which evens out their spread."""
    flat = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    sizes = np.array([len(x) for x in texts], np.int64)
    starts = np.cumsum(sizes + 1) - sizes - 1
    count = lambda table: np.add.reduceat(table[flat].astype(np.int64), starts) - (sizes * 0 + bool(table[10]))
    chars = np.maximum(count(WORD_BYTE), 1)
    classes = [np.sqrt(np.maximum(count(c), 0) / chars) for c in _CLASSES]
    words, n = word_hashes(texts)
    least = np.maximum(n, 1)
    first = np.cumsum(n) - n
    same = np.r_[False, words[1:] == words[:-1]]
    same[first[(n > 0) & (first < len(words))]] = False
    total = np.r_[0, np.cumsum(same)]
    stutter = np.sqrt((total[first + n] - total[first]) / least)
    three = words[:-2] * np.uint64(3) + words[1:-1] * np.uint64(0x9E3779B97F4A7C15) + words[2:] * np.uint64(0xC2B2AE3D27D4EB4F) if len(words) > 2 else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(n)), n)
    inside = owner[:-2] == owner[2:] if len(words) > 2 else np.zeros(0, bool)
    grams = np.bincount(owner[:-2][inside], minlength=len(n)) if len(words) > 2 else np.zeros(len(n), np.int64)
    again = np.sqrt(_repeats(three[inside], grams) / np.maximum(grams, 1))
    lines = [[x for x in t.split(b"\n") if x.strip()] for t in texts]
    doubled = np.sqrt(np.array([1 - len(set(x)) / len(x) if x else 0.0 for x in lines]))
    fresh = 1 - _repeats(words, n) / least
    length = np.log1p(n)
    return np.c_[length, (length - 5) ** 2, np.log(chars / least), *classes, stutter, again, doubled, fresh, fresh * length]


@dataclass
class Model:
    centre: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float
    spread: float

    def score(self, x: np.ndarray) -> np.ndarray:
        z = (((x - self.centre) / self.scale) @ self.weights - self.threshold) / self.spread
        return 1 / (1 + np.exp(-np.clip(z, -700, 700)))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in small_batches(whole, "text", 2 << 20):
            x = features(text_bytes(batch.column("text")))
            yield pa.RecordBatch.from_arrays([batch.column("y"), pa.array(list(x), pa.list_(pa.float64()))], ["y", "x"])


def fit(docs: DataFrame, labels: DataFrame, train: Column, *, id_col: str = "doc_id", text_col: str = "text", label: str = "quality", per_class: int = 6000, pairs: int = 60_000, ridge: float = 1.0, seed: int = 3) -> Model:
    """train is a condition on the labels' rows; per_class and pairs bound the sample and the preference pairs drawn from it."""
    texts = docs.select(F.col(id_col).alias("doc"), F.col(text_col).cast("string").alias("text"))
    rows, sizes = sample(texts, labels.select(F.col(id_col).alias("doc"), label), label, train, per_class, id_col="doc")
    n_features = features([b""]).shape[1]
    if len(sizes) < 2:
        only = next(iter(sizes), None)
        return Model(np.zeros(n_features), np.ones(n_features), np.zeros(n_features), 0.0 if only is None else (-50.0 if only else 50.0), 1.0)
    found = rows.select("y", "text").mapInArrow(_features, "y int, x array<double>").toPandas()  # at most 2 * per_class rows
    x, y = np.array(found.x.tolist()), found.y.to_numpy()
    order = np.lexsort((*x.T, y))  # whatever order the rows came in
    x, y = x[order], y[order]
    centre, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-3)
    z = (x - centre) / scale
    rng = np.random.default_rng(seed)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        return Model(centre, scale, np.zeros(n_features), 0.0, 1.0)
    a, b = rng.choice(good, pairs), rng.choice(bad, pairs)
    sign = np.where(rng.random(pairs) < 0.5, 1.0, -1.0)  # either one first
    w = logistic((z[a] - z[b]) * sign[:, None], (sign > 0).astype(float), np.ones(pairs), ridge)
    s = z @ w
    weight = np.where(y == 1, sizes[1] / len(good), sizes[0] / len(bad))
    rank = np.argsort(s, kind="stable")
    share = np.cumsum(weight[rank]) / weight.sum()
    at = int(np.searchsorted(share, sizes[0] / (sizes[0] + sizes[1])))
    above = s[rank[min(at + 1, len(s) - 1)]]
    return Model(centre, scale, w, float((s[rank[min(at, len(s) - 1)]] + above) / 2), float(max(s.std() / 4, 1e-6)))


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in small_batches(whole, "text", 2 << 20):
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(list(features(text_bytes(batch.column("text")))), pa.list_(pa.float64()))], ["id", "x"])


def vectors(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, x): the statistics of every whole text."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_vectors, f"id {rows.schema['id'].dataType.simpleString()}, x array<double>").withColumnRenamed("id", id_col)


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(len(column), -1)


def _summed(rows: DataFrame, f, keys: int, width: int) -> np.ndarray:
    """The sum [keys, width] of f(x, y) = (keys of the rows of a matrix, matrix) over all rows (y, x); what is sent is one row a key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((keys, width))
        for batch in batches:
            if batch.num_rows:
                at, part = f(_matrix(batch.column("x")), batch.column("y").to_numpy())
                np.add.at(total, at, part)
        used = np.flatnonzero(total.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), *[pa.array(c) for c in total[used].T]], ["key", *[f"v{i}" for i in range(width)]])

    cols = [f"v{i}" for i in range(width)]
    found = rows.select("y", "x").mapInArrow(run, "key int, " + ", ".join(f"{c} double" for c in cols)).groupBy("key").agg(*[F.sum(c).alias(c) for c in cols])
    out = np.zeros((keys, width))
    for r in found.collect():
        out[r["key"]] = r[1:]
    return out


#: Bins of asinh(score): 0.01 wide, far beyond any score that a pair could still learn from.
_HALF = 800
_BINS = 2 * _HALF + 1


def _bin(s: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(np.arcsinh(s) * 100), -_HALF, _HALF).astype(np.int64) + _HALF


def _all_pairs(rows: DataFrame, centre: np.ndarray, scale: np.ndarray, n: tuple[float, float], pairs: int, ridge: float, steps: int = 40) -> np.ndarray:
    """Weights that minimise the logistic loss over all pairs of a good and a bad row, which together weigh `pairs`, plus ridge/2 |w|^2. Pairs are taken by
    bins, a bin's rows at their mean score."""
    d, share = len(centre), pairs / (n[0] * n[1])

    def binned(w: np.ndarray):
        def f(x: np.ndarray, y: np.ndarray):
            z = (x - centre) / scale
            s = z @ w
            return y * _BINS + _bin(s), np.c_[np.ones(len(s)), s, z]

        total = _summed(rows, f, 2 * _BINS, d + 2)
        parts = []
        for y in (0, 1):
            own = total[y * _BINS : (y + 1) * _BINS]
            used = np.flatnonzero(own[:, 0])
            parts.append((used, own[used, 0], own[used, 1] / own[used, 0], own[used, 2:]))
        (_, nb, sb, _), (_, ng, sg, _) = parts
        gap = sg[:, None] - sb[None]
        return parts, gap, float(share * (ng @ np.logaddexp(0, -gap) @ nb) + ridge / 2 * w @ w)

    w = np.zeros(d)
    parts, gap, now = binned(w)
    for _ in range(steps):
        (ub, nb, _, zb), (ug, ng, _, zg) = parts
        p = 1 / (1 + np.exp(np.clip(gap, -500, 500)))
        q = p * (1 - p)
        gradient = share * (zb.T @ (ng @ p) - zg.T @ (p @ nb)) + ridge * w
        weight = np.zeros((2, _BINS))
        weight[0, ub], weight[1, ug] = ng @ q, q @ nb

        def moments(x: np.ndarray, y: np.ndarray, w=w, weight=weight):
            z = (x - centre) / scale
            return np.arange(d), (z * weight[y, _bin(z @ w)][:, None]).T @ z

        cross = zg.T @ q @ zb
        hessian = share * (_summed(rows, moments, d, d) - cross - cross.T) + ridge * np.eye(d)
        step, size = np.linalg.solve(hessian, gradient), 1.0
        while True:
            after = binned(w - size * step)
            if after[2] <= now or size < 1e-4:
                break
            size /= 2
        if after[2] > now:
            break
        w, gain = w - size * step, now - after[2]
        parts, gap, now = after
        if gain < 1e-8 * (1 + abs(now)):
            break
    return w


def _around(scores: DataFrame, k: int, n: int, most: int = 20_000) -> tuple[float, float]:
    """The k-th and the next of n scores (column s) in order, k from 1: bins around the k-th, narrowed until few enough rows are left to send."""
    low, high, before = *scores.agg(F.min("s"), F.max("s")).first(), 0
    while True:
        inside = scores.where(F.col("s").between(low, high))
        if low == high:
            found = np.full(n - before, low)[: k + 1 - before]
            break
        bins = 4096
        place = F.least(F.floor((F.col("s") - low) / (high - low) * bins), F.lit(bins - 1))
        rows = sorted(inside.groupBy(place.alias("b")).agg(F.count("*").alias("n"), F.min("s").alias("low"), F.max("s").alias("high")).collect())
        total = before + np.cumsum([r["n"] for r in rows])
        at = int(np.searchsorted(total, k))
        low, high, before = rows[at]["low"], rows[at]["high"], int(total[at]) - rows[at]["n"]
        following = rows[at + 1]["low"] if at + 1 < len(rows) else None
        if k == total[at] and following is not None:  # the next one begins another bin
            return high, following
        if rows[at]["n"] <= most:
            found = np.sort([r["s"] for r in scores.where(F.col("s").between(low, high)).collect()])
            break
    first = found[k - before - 1]
    return float(first), float(found[min(k - before, len(found) - 1)])


def fit_all(found: DataFrame, labels: DataFrame, train: Column, *, id_col: str = "doc_id", label: str = "quality", pairs: int = 60_000, ridge: float = 1.0) -> Model:
    """found: vectors() of all documents, stored; train is a condition on the labels' rows (column doc). All training rows count; `pairs` is what all their pairs
    weigh against the ridge."""
    own = classes(labels.select(F.col(id_col).alias("doc"), label), label, train, "doc")
    rows = stored(found.join(own, F.col(id_col) == F.col("__id")).select("y", "x"), "quality-training")
    d = features([b""]).shape[1]
    first = _summed(rows, lambda x, y: (y, np.c_[np.ones(len(y)), x]), 2, d + 1)
    n = first[:, 0]
    if not n.all():
        only = None if not n.any() else int(n[1] > 0)
        return Model(np.zeros(d), np.ones(d), np.zeros(d), 0.0 if only is None else (-50.0 if only else 50.0), 1.0)
    centre = first[:, 1:].sum(axis=0) / n.sum()
    spread = _summed(rows, lambda x, y: (np.zeros(1, int), ((x - centre) ** 2).sum(axis=0)[None]), 1, d)[0]
    scale = np.maximum(np.sqrt(spread / n.sum()), 1e-3)
    # sums differ in their last bits from run to run
    centre, scale = centre.round(10), scale.round(10)
    w = _all_pairs(rows, centre, scale, (n[0], n[1]), pairs, ridge).round(7)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(((_matrix(batch.column("x")) - centre) / scale) @ w)], ["s"])

    scores = stored(rows.select("x").mapInArrow(run, "s double"), "quality-scores")
    below, above = _around(scores, int(n[0]), int(n.sum()))
    return Model(centre, scale, w, (below + above) / 2, float(max(scores.agg(F.stddev_pop("s")).first()[0] / 4, 1e-6)))


def score_vectors(found: DataFrame, model: Model, *, id_col: str = "doc_id") -> DataFrame:
    """(id, score) of vectors(): 0 to 1, 0.5 at the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(model.score(_matrix(batch.column("x"))))], ["id", "score"])

    rows = found.select(F.col(id_col).alias("id"), "x")
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, score double").withColumnRenamed("id", id_col)


def _score(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in small_batches(whole, "text", 2 << 20):
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(model.score(features(text_bytes(batch.column("text")))))], ["id", "score"])

    return run


def score(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score): 0 to 1, 0.5 at the threshold."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_score(model), f"id {rows.schema['id'].dataType.simpleString()}, score double").withColumnRenamed("id", id_col)
