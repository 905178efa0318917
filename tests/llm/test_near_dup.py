import random

from pyspark.sql import functions as F

from quillgraph.llm import near_dup
from quillgraph.llm.shingles import shingle_hashes, word_hashes

WORDS = [f"w{i}" for i in range(400)]


def sets(text, k):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def brute(rows, k, pct):
    s = {i: sets(t, k) for i, t in rows}
    comp = {i: i for i in s}

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for a in s:
        for b in s:
            if a < b and s[a] and s[b] and 100 * len(s[a] & s[b]) >= pct * len(s[a] | s[b]):
                x, y = find(a), find(b)
                comp[max(x, y)] = min(x, y)
    return {i: (len(s[i]), find(i)) for i in s}


def corpus(seed):
    rng = random.Random(seed)
    out = []
    for i in range(12):
        base = [rng.choice(WORDS) for _ in range(rng.choice([1, 2, 3, 12, 60, 200]))]
        for _ in range(rng.choice([1, 2, 5, 9])):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                w[rng.randrange(len(w))] = rng.choice(WORDS)
            out.append(" ".join(w).upper() if rng.random() < 0.2 else "  ".join(w))
    chain = [rng.choice(WORDS) for _ in range(100)]
    for i in range(12):  # each near to the next, the ends far apart
        chain = chain[:]
        chain[i * 8] = f"x{i}"
        out.append(" ".join(chain))
    return [*enumerate([*out, "", None, "\n", *out[:3]])]


def test_against_all_pairs(spark):
    for seed, (k, pct) in ((1, (3, 85)), (2, (5, 80)), (3, (3, 85))):
        rows = corpus(seed)
        df = spark.createDataFrame(rows, "doc_id long, text string")
        found = near_dup.near_duplicates(df, shingle=k, threshold_pct=pct, tile=2 if seed == 3 else 4, batch=5)
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in found.collect()}
        assert got == brute(rows, k, pct)


def test_many_similar_texts_in_one_bucket(spark):
    rng = random.Random(5)
    common = [rng.choice(WORDS) for _ in range(60)]
    rows = [(i, " ".join(common + [rng.choice(WORDS) for _ in range(12 if i % 2 else 4)])) for i in range(80)]
    found = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle=3, threshold_pct=85, tile=16, batch=64)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found.collect()} == brute(rows, 3, 85)


def test_a_giant_bucket_with_a_stray_class_stays_linear(spark):
    for m in (200, 400, 800):
        one = spark.range(m).select(F.lit(0).alias("band"), F.lit(7).cast("long").alias("hash"), F.col("id").cast("string").cast("binary").alias("digest"), F.when(F.col("id") < 3, F.col("id")).otherwise(9).alias("label"))
        found = near_dup.tiles(one, 32)
        assert found.count() <= 3 * (m / 32 + 2) + m  # 3 strays against all tiles, and everyone once
        assert found.groupBy("band", "hash", "low", "high").count().agg(F.max("count")).first()[0] <= 3 + 64
    rng = random.Random(1)
    rows = [(i, rng.randrange(5)) for i in range(90)]
    split = spark.createDataFrame(rows, "id long, label long").select(F.lit(0).alias("band"), F.lit(0).cast("long").alias("hash"), F.col("id").cast("string").cast("binary").alias("digest"), "label")
    seen = set()
    by = {}
    for r in near_dup.tiles(split, 8).collect():
        by.setdefault((r.low, r.high), ([], []))[r.side].append((int(r.digest), r.label))
    for left, right in by.values():
        pairs = [(x, y) for k, x in enumerate(left) for y in (right or left[k + 1 :]) if x[1] != y[1]]
        new = {tuple(sorted((x[0], y[0]))) for x, y in pairs}
        assert len(new) == len(pairs) and not new & seen  # each pair once
        seen |= new
    label = dict(rows)
    assert seen == {(i, j) for i in range(90) for j in range(i + 1, 90) if label[i] != label[j]}


def test_odd_sketch_estimates():
    import numpy as np

    rng = np.random.default_rng(3)
    for s in (0.95, 0.85, 0.7):
        n = 400
        shared = int(2 * n * s / (1 + s))
        far = []
        for _ in range(40):
            a = rng.integers(0, 1 << 63, 2 * n, dtype=np.uint64)
            x, y = np.sort(a[:n]), np.sort(np.r_[a[:shared], a[n : 2 * n - shared]])
            _, odd = near_dup.sketches(np.concatenate([x, y]), np.array([n, n]), 30, 4)
            far.append(int(np.bitwise_count(odd[0] ^ odd[1]).sum()))
        assert abs(np.mean(far) - near_dup.odd_distance(s, 120)) < 5
        assert max(far) <= near_dup.odd_distance(s - 0.2, 120)


def test_word_and_shingle_hashes():
    h, n = word_hashes([b"a B a", b"", b"b \t\n a", b"  "])
    assert list(n) == [3, 0, 2, 0] and h[0] == h[2] == h[4] and h[1] == h[3] and len(set(h)) == 2
    s, c = shingle_hashes([b"a b c d", b"a b", b"a", b""], 3)
    assert list(c) == [2, 1, 1, 0] and len(set(s)) == 4


def test_odd_rows_and_keep_one(spark, odd_rows):
    found = near_dup.near_duplicates(odd_rows)
    by = {(r.doc_id, r.n_shingles): r for r in found.collect()}
    assert len(found.collect()) == odd_rows.count()
    assert by[3, 0].component_id == 3 and by[3, 0].kept and by[4, 0].kept and by[2, 0].kept
    kept = near_dup.keep_one(odd_rows.withColumn("n", F.lit(1)).withColumn("component_key", F.lit("x")).withColumn("digest", F.lit(2)))
    assert kept.count() == odd_rows.count() - 1 and kept.columns[-3:] == ["n", "component_key", "digest"]
    assert near_dup.near_duplicates(odd_rows.limit(0)).count() == 0 and near_dup.keep_one(odd_rows.limit(0)).count() == 0
    same = odd_rows.where("doc_id = 1").unionByName(odd_rows.where("doc_id = 1").withColumn("doc_id", F.lit(None).cast("long"))).unionByName(odd_rows.where("doc_id = 1").withColumn("doc_id", F.lit(0).cast("long")))
    assert [r.doc_id for r in near_dup.keep_one(same).collect()] == [0]
