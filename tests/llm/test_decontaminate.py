import random
import re

from pyspark.sql import functions as F

from quillgraph.llm import wu_manber

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(t):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(text, items, size):
    w, hit, own = words(text), set(), set()
    for item, t in items:
        v = words(t)
        for win in [v[i : i + size] for i in range(len(v) - size + 1)] if len(v) >= size else [v] if v else []:
            for i in range(len(w) - len(win) + 1):
                if w[i : i + len(win)] == win:
                    hit |= set(range(i, i + len(win)))
                    own.add(item)
    return len(w), sorted(hit), sorted(own, key=str)


def test_against_direct_comparison(spark):
    rng = random.Random(2)
    letters = ["a", "b", "É", "ß9", "c"]
    make = lambda n: " ".join(rng.choice(letters) for _ in range(n))
    items = [(i, make(rng.choice([1, 2, 4, 5, 9]))) for i in range(8)] + [(8, None), (9, "-- !"), (10, "a-B.c É"), (11, "A b C É")]
    docs = [(i, make(rng.choice([0, 1, 3, 30]))) for i in range(40)] + [(40, None), (41, "A--b_cé")]
    for block in (1 << 20, 40):
        found = wu_manber.scan(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), window=4, block_bytes=block, prefix="")
        for r in found.collect():
            n, hit, own = brute(dict(docs)[r.doc_id], [x for x in items if x[1] is not None], 4)
            assert r.n_words == n and [i for s in r.spans for i in range(s.start, s.end)] == hit
            assert sorted(r["items"]) == sorted(map(str, own))


def test_shift_skips():
    m = wu_manber.Machine({tuple(b"%d" % i for i in range(10)): {1}}, 10)

    class Counting(list):
        seen = 0

        def __getitem__(self, i):
            Counting.seen += not isinstance(i, slice)
            return super().__getitem__(i)

    assert list(m.find(Counting([b"x"] * 900))) == [] and Counting.seen <= 2 * 100 + 2


def test_odd_rows_and_clean(spark, odd_rows):
    bench = spark.createDataFrame([(1, "the lazy dog and runs away from the very big bad"), (None, "one"), (2, None)], "item_id long, text string")
    marked = wu_manber.scan(odd_rows.withColumn("n_words", F.lit("mine")), bench)
    assert marked.count() == odd_rows.count() and "n_words" in marked.columns
    kept = wu_manber.clean(odd_rows.withColumn("start", F.lit(1)), bench)
    assert kept.count() == odd_rows.count() - 1 and kept.where("doc_id = 1").count() == 0 and kept.columns[-1] == "start"
    assert wu_manber.clean(odd_rows, bench.limit(0)).count() == odd_rows.count()
    assert wu_manber.clean(odd_rows.limit(0), bench).count() == 0


def test_columns_named_like_the_results(spark, odd_rows):
    bench = spark.createDataFrame([(1, "the lazy dog and runs away from the very big bad"), (7, "one")], "item_id long, text string")
    docs = odd_rows.withColumns({"decon_items": F.array(F.lit("x")), "decon_spans": F.lit(3), "__wm_items": F.array(F.lit("mine")), "__wm_words": F.lit("w")})
    for block in (1 << 20, 10):
        out = wu_manber.scan(docs, bench, block_bytes=block)
        assert out.columns == [c for c in docs.columns if not c.startswith("decon")] + ["decon_n_words", "decon_spans", "decon_items"]
        got = {r.doc_id: r for r in out.where("doc_id in (1, 5)").collect()}
        assert got[1].decon_items == ["1"] and got[5].decon_items == ["7"] and got[5]["__wm_items"] == ["mine"] and out.where("size(decon_items) > 0").count() == 3
        assert wu_manber.clean(docs, bench).columns == docs.columns
