import math
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from quillgraph.llm import ctw, lm_score

DEPTH = 3


def coded(text):
    return b" ".join([*(text or "").encode().lower().split(), b"\n"])


def brute(train, texts):
    """Context-tree weighting by its definition: recursion over nodes in plain Python."""
    counts = defaultdict(lambda: [0, 0])
    children = defaultdict(set)
    for t in map(coded, train):
        data = b"\0" * DEPTH + t
        for i in range(DEPTH, len(data)):
            for j in range(8):
                prefix, bit = (1, data[i] >> (8 - j)) if j else (1, 0), data[i] >> (7 - j) & 1
                for d in range(DEPTH + 1):
                    counts[data[i - d : i], j, prefix[1]][bit] += 1
                    if d:
                        children[data[i - d + 1 : i], j, prefix[1]].add(data[i - d : i])

    def pe(n):
        return math.lgamma(n[0] + 0.5) + math.lgamma(n[1] + 0.5) - math.lgamma(sum(n) + 1) - math.log(math.pi)

    memo = {}

    def pw(c, j, p):
        if (c, j, p) not in memo:
            own = pe(counts[c, j, p])
            memo[c, j, p] = own if len(c) == DEPTH else np.logaddexp(math.log(0.5) + own, math.log(0.5) + sum(pw(k, j, p) for k in children[c, j, p]))
        return memo[c, j, p]

    def bit_p(context, j, p, bit):
        if (b"", j, p) not in counts:
            return 0.5
        path = [c for c in (context[DEPTH - d :] for d in range(DEPTH + 1)) if (c, j, p) in counts]
        total, left = 0.0, 1.0
        for k, c in enumerate(path):
            n = counts[c, j, p]
            w = 1.0 if k == len(path) - 1 else math.exp(math.log(0.5) + pe(n) - pw(c, j, p))
            total += left * w * (n[bit] + 0.5) / (sum(n) + 1)
            left *= 1 - w
        return total

    out = []
    for t in map(coded, texts):
        data, s = b"\0" * DEPTH + t, 0.0
        for i in range(DEPTH, len(data)):
            for j in range(8):
                s += math.log10(bit_p(data[i - DEPTH : i], j, data[i] >> (8 - j) if j else 0, data[i] >> (7 - j) & 1))
        out.append(s)
    return out


def test_against_the_definition(spark):
    texts = ["the cat sat", "the hat", "a cat", "The  CAT\nsat on", "zzz", "", None]
    held = [False, False, False, True, True, False, True]
    df = spark.createDataFrame([(i, t, h) for i, (t, h) in enumerate(zip(texts, held, strict=True))], "doc_id long, text string, h boolean").repartition(3)
    got = {r.doc_id: r for r in lm_score.score_documents(df, F.col("h"), depth=DEPTH, block_bytes=16).collect()}
    train = [t for t, h in zip(texts, held, strict=True) if not h]
    for i, s in enumerate(brute(train, texts)):
        assert abs(got[i].score - s) < 1e-4 * max(1, -s), i
    words = Counter(w for t in train for w in [*coded(t).split(), b"END"])
    n, v = sum(words.values()), len(words)
    for i, t in enumerate(texts):
        w = [*coded(t).split(), b"END"]
        assert (got[i].n_tokens, got[i].train_tokens, got[i].held_out) == (len(w), n, held[i])
        assert got[i].n_known == sum(words[x] > 0 for x in w)
        assert abs(got[i].base_score - sum(math.log10((words[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)) < 1e-9


def test_probabilities_sum_to_one():
    rng = np.random.default_rng(0)
    flat = rng.integers(97, 101, 400).astype(np.uint8)
    keys, counts = ctw.merged(ctw.grams(flat, 3)[3:], np.ones(397, np.int64))
    contexts = np.unique(keys >> np.uint64(8))[:5]
    asked = np.concatenate([(contexts << np.uint64(8)) | np.uint64(b) for b in range(256)])
    allk, alln = ctw.merged(np.concatenate([keys, asked]), np.concatenate([counts, np.zeros(len(asked), np.int64)]))
    rows, n, sums = ctw.subtree_sums(allk, alln, 3, 2)
    p = 10 ** ctw.gram_scores(allk, alln, 3, 2, rows, ctw.crown(rows, n, sums, 2))
    for c in contexts:
        assert abs(p[(allk >> np.uint64(8)) == c].sum() - 1) < 1e-9


def test_lookup_finds_all():
    keys = np.unique(np.random.default_rng(1).integers(0, 1 << 63, 5000, dtype=np.uint64))
    values = np.arange(len(keys), dtype=np.float32)
    assert (lm_score.Lookup(keys, values)(keys[::-1]) == values[::-1]).all()


def test_odd_rows(spark, odd_rows):
    got = lm_score.score_documents(odd_rows, F.lit(None).cast("boolean")).collect()
    assert len(got) == odd_rows.count() and all(r.score < 0 and r.train_tokens > 0 for r in got)
    assert lm_score.score_documents(odd_rows.limit(0), F.lit(True)).count() == 0
    only = lm_score.score_documents(odd_rows.where("doc_id = 5"), F.lit(True)).collect()
    assert len(only) == 2 and only[0].train_tokens == 0 and abs(only[0].score + only[0].n_bytes * 8 * math.log10(2)) < 1e-5


def test_cuts_do_not_change_scores(spark):
    rng = np.random.default_rng(2)
    words = ["".join(map(chr, rng.integers(97, 102, 5))) for _ in range(60)]
    rows = [(i, " ".join(rng.choice(words, 30)), i % 3 == 0) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, h boolean").repartition(3)
    got = [
        {r.doc_id: r.score for r in lm_score.score_documents(df, F.col("h"), depth=5, cut=cut, root=root, block_bytes=block).collect()}
        for cut, root, block in ((4, 2, 64), (3, 1, 256), (5, 2, 16 << 20))
    ]
    for other in got[1:]:
        assert all(abs(other[i] - s) < 1e-5 * -s for i, s in got[0].items())


def test_a_hot_context_is_dealt_over_parts():
    """Texts whose last two bytes of context are nearly always the same: dealt by four bytes, no part holds more than a few of them."""
    keys = (np.arange(1 << 16, dtype=np.uint64) << np.uint64(24)) | np.uint64(0x6574_61)
    assert len(np.unique(lm_score._gram_part(keys, 2, 50))) == 1
    assert np.bincount(lm_score._gram_part(keys, 4, 50)).max() < 2 * len(keys) / 50
