"""Toxicity by maximum-scoring segments.

Token log-odds between toxic and other training documents, from the numbers of documents that hold a token, are smoothed by an
informative Dirichlet prior (the background's shares, scaled to `prior`, plus `flat` for each token); tokens whose z-score reaches `z_least` keep their
log-odds, all others share the drift, a small cost per token. In a document, all maximal scoring segments are found in one pass over its tokens.
A segment of score S among n tokens has the expected number E = K n exp(-lambda S) of segments as good by chance (Karlin and
Altschul): lambda solves sum p exp(lambda s) = 1 over the tokens of non-toxic documents, occurrences counted, and K is the likeliest for these documents' best
scores M, whose law is P(M <= x) = exp(-K n exp(-lambda x)): the number of documents with a segment over the sum of n exp(-lambda M). Passages with E under
`significant` count, the document's evidence is the sum of their -ln E, and a logistic curve, fitted on the sample with the classes' true weights,
turns it into a score.

The sample is bounded (`per_class` rows a class), and so are the lexicon and what is collected of it, by the sample's words; scoring is one narrow pass over all
whole texts with the lexicon in the closure. Null and empty texts have no passages and get the score of no evidence. Without labels of both classes that is the
share of toxic ones (or 0.5 without any). Repeated rows are scored alike, very long texts whole; an empty table gives an empty result. Ties in the sample's order
go by id. Of columns other than id and text none is read, whatever their names.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_bytes
from .labelled import logistic, sample
from .wu_manber import words_of


@dataclass
class Model:
    lexicon: dict[bytes, float] = field(default_factory=dict)
    drift: float = -0.1
    rate: float = 1.0
    k: float = 0.1
    significant: float = 1e-3
    offset: float = 0.0
    slope: float = 0.0


def maximal_segments(hits: list[tuple[int, float]], drift: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score) of a sequence whose tokens score `drift`, but for the hits.

    hits: (position, score) in order. Each positive token starts as a segment of its own; a segment joins back to the nearest one that
    starts lower as long as it ends higher. Links to that nearest one make the search linear in all.
    """
    found: list[tuple[float, float, int, int, int]] = []  # total before, total after, start, end, link
    total, last = 0.0, 0
    for at, score in hits:
        total += (at - last) * drift
        last = at + 1
        if score <= 0:
            total += score
            continue
        low, high, start = total, total + score, at
        total = high
        j = len(found) - 1
        while True:
            while j >= 0 and found[j][0] >= low:
                j = found[j][4]
            if j < 0 or found[j][1] >= high:
                found.append((low, high, start, at + 1, j))
                break
            low, start = found[j][0], found[j][2]
            before = found[j][4]
            del found[j:]
            j = before
    return [(start, end, high - low) for low, high, start, end, _ in found]


def passages(model: Model, words: list[bytes]) -> list[tuple[int, int, float, float]]:
    """(start, end, score, logarithm of the expected number by chance) of the significant segments."""
    get = model.lexicon.get
    hits = [(i, s) for i, s in enumerate(map(get, words)) if s is not None]
    out = []
    for start, end, score in maximal_segments(hits, model.drift):
        e = math.log(model.k * len(words)) - model.rate * score
        if e < math.log(model.significant):
            out.append((start, end, score, e))
    return out


def evidence(found: list[tuple[int, int, float, float]]) -> float:
    return sum(-e for *_, e in found)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    by: tuple[Counter, Counter] = (Counter(), Counter())
    uses: Counter = Counter()
    for batch in batches:
        for text, y in zip(text_bytes(batch.column("text")), batch.column("y").to_pylist(), strict=True):
            words = words_of(text)
            by[y].update(set(words))
            if y == 0:
                uses.update(words)
    words = sorted(by[0].keys() | by[1].keys())
    if words:
        yield pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), *[pa.array([c[w] for w in words], pa.int64()) for c in (*by, uses)]], ["token", "clean", "toxic", "uses"])


def log_odds(counts: DataFrame, prior: float, flat: float) -> DataFrame:
    """counts (token, clean, toxic, ...) of documents that hold a token, with odds and z. With n the class's sum of counts and a the token's prior weight, a class's
    part is ln((y + a) / (n + prior + flat - y)); odds is the difference of both, z is odds over sqrt(1 / (toxic + a) + 1 / (clean + a))."""
    total = counts.agg(F.sum("clean").alias("nc"), F.sum("toxic").alias("nt")).first()
    nc, nt = total["nc"] or 0, total["nt"] or 0
    a = (F.col("clean") + F.col("toxic")) * F.lit(prior / max(nc + nt, 1)) + flat
    rate = lambda y, n: F.ln((y + a) / (F.lit(n + prior) + flat - y))
    odds = rate(F.col("toxic"), nt) - rate(F.col("clean"), nc)
    spread = F.sqrt(1 / (F.col("toxic") + a) + 1 / (F.col("clean") + a))
    return counts.withColumn("odds", odds).withColumn("z", odds / spread)


def _rate(scores: np.ndarray, p: np.ndarray) -> float:
    """The positive lambda with sum p exp(lambda s) = 1; 1 if no score is positive."""
    if not (scores > 0).any() or (p * scores).sum() >= 0:
        return 1.0
    low, high = 1e-6, 1.0
    while (p * np.exp(np.minimum(high * scores, 700))).sum() < 1 and high < 64:
        high *= 2
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if (p * np.exp(np.minimum(mid * scores, 700))).sum() < 1 else (low, mid)
    return max(high, 0.05)


def likeliest_k(n: np.ndarray, best: np.ndarray, rate: float) -> float:
    """K from the numbers of tokens and the best scores (0: no segment) of documents: what makes them likeliest under P(M <= x) = exp(-K n exp(-rate x)); the
    prior of half a document keeps it positive."""
    return float(((best > 0).sum() + 0.5) / max((n * np.exp(-rate * best)).sum(), 1.0))


def fit(docs: DataFrame, labels: DataFrame, train: Column, *, id_col: str = "doc_id", text_col: str = "text", label: str = "toxic", per_class: int = 8000, prior: float = 100.0, flat: float = 0.5, z_least: float = 3.0, drift: float = -0.1, significant: float = 1e-3) -> Model:
    """train is a condition on the labels' rows; per_class bounds the sample."""
    texts = docs.select(F.col(id_col).alias("doc"), F.col(text_col).cast("string").alias("text"))
    rows, sizes = sample(texts, labels.select(F.col(id_col).alias("doc"), label), label, train, per_class, id_col="doc")
    rows = rows.select("text", "y")
    model = Model(drift=drift, significant=significant)
    if len(sizes) < 2:
        share = (sizes.get(1, 0) / sum(sizes.values())) if sizes else 0.5
        model.offset = math.log((share + 0.01) / (1.01 - share))
        return model
    counts = rows.mapInArrow(_counts, "token binary, clean long, toxic long, uses long").groupBy("token").agg(*[F.sum(c).alias(c) for c in ("clean", "toxic", "uses")])
    marked = log_odds(counts, prior, flat).where(F.abs("z") >= z_least).orderBy("token").collect()  # of the sample's words
    model.lexicon = {bytes(r.token): r.odds for r in marked}
    facts = rows.mapInArrow(_best(model), "y int, n long, best double").toPandas()  # at most 2 * per_class rows
    clean = facts[facts.y == 0]
    known = np.array([r.uses for r in marked], float) / max(int(clean.n.sum()), 1)
    scores = np.array([r.odds for r in marked])
    model.rate = _rate(np.r_[scores, drift], np.r_[known, max(0.0, 1 - known.sum())])
    model.k = likeliest_k(clean.n.to_numpy(float), clean.best.to_numpy(float), model.rate)
    seen = rows.mapInArrow(_evidence(model), "y int, x double").toPandas()  # as many
    y, x = seen.y.to_numpy(float), seen.x.to_numpy(float)
    have = {c: max(int((y == c).sum()), 1) for c in (0, 1)}
    weight = np.where(y == 1, sizes[1] / have[1], sizes[0] / have[0])
    model.offset, model.slope = logistic(np.c_[np.ones(len(x)), x], y, weight / weight.mean(), 1e-3)
    return model


def _best(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [words_of(x) for x in text_bytes(batch.column("text"))]
            best = []
            for w in words:
                hits = [(i, s) for i, s in enumerate(map(model.lexicon.get, w)) if s is not None]
                best.append(max((s for *_, s in maximal_segments(hits, model.drift)), default=0.0))
            yield pa.RecordBatch.from_arrays([batch.column("y"), pa.array([len(w) for w in words], pa.int64()), pa.array(best, pa.float64())], ["y", "n", "best"])

    return run


def _evidence(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [evidence(passages(model, words_of(t))) for t in text_bytes(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("y"), pa.array(x, pa.float64())], ["y", "x"])

    return run


def probability(model: Model, x: float) -> float:
    z = model.offset + model.slope * x
    return 1 / (1 + math.exp(-z)) if z > -700 else 0.0


def _score(model: Model):
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("log_expected", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores, xs, spans = [], [], []
            for text in text_bytes(batch.column("text")):
                found = passages(model, words_of(text))
                x = evidence(found)
                xs.append(x)
                scores.append(probability(model, x))
                spans.append([dict(zip(("start", "end", "score", "log_expected"), p, strict=True)) for p in found])
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(scores, pa.float64()), pa.array(xs, pa.float64()), pa.array(spans, span)], ["id", "score", "evidence", "passages"])

    return run


def score(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, evidence, passages): passages are word ranges [start, end) with their scores and the natural logarithms of their expected numbers."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(_score(model), f"id {kind}, score double, evidence double, passages array<struct<start: int, end: int, score: double, log_expected: double>>").withColumnRenamed("id", id_col)
