import random
import re
from html.parser import HTMLParser

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillgraph.llm import html_layout, quality_rank, toxicity
from quillgraph.llm.common import crc_share
from quillgraph.llm.html_layout import render

SF = "/root/testdata/sf0.1"


def naive_segments(scores):
    """Maximal scoring segments by their recursive definition: the best segment, then left and right of it."""
    best = max(((sum(scores[i:j]), -i, -j) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)), default=(0, 0, 0))
    if best[0] <= 0:
        return []
    i, j = -best[1], -best[2]
    j = min(k for k in range(i + 1, len(scores) + 1) if sum(scores[i:k]) == best[0])
    left = naive_segments(scores[:i])
    right = [(a + j, b + j, s) for a, b, s in naive_segments(scores[j:])]
    return [*left, (i, j, best[0]), *right]


def test_segments_are_the_maximal_ones():
    rng = random.Random(1)
    for _ in range(200):
        n = rng.randrange(1, 14)
        hits = {i: rng.choice([-3.0, -1.0, 2.0, 5.0, 1.0]) + rng.random() for i in range(n) if rng.random() < 0.6}
        scores = [hits.get(i, -0.5) for i in range(n)]
        got = toxicity.maximal_segments(sorted(hits.items()), -0.5)
        want = naive_segments(scores)
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want]
        assert [s for *_, s in got] == pytest.approx([s for *_, s in want])


def test_expected_numbers_are_calibrated_on_random_texts():
    rng = np.random.default_rng(6)
    words, p, s = [b"a", b"b", b"c", b"-"], [0.02, 0.03, 0.05, 0.9], [4.0, 2.5, -1.0]
    model = toxicity.Model(lexicon=dict(zip(words, s, strict=False)), drift=-0.3, significant=1e9)
    model.rate = toxicity._rate(np.array([*s, -0.3]), np.array(p))
    assert abs(sum(q * np.exp(model.rate * x) for q, x in zip(p, [*s, -0.3], strict=True)) - 1) < 1e-6

    def texts(n):
        return [[words[i] for i in rng.choice(4, rng.integers(50, 400), p=p)] for _ in range(n)]

    seen = texts(1500)
    best = [max((x for *_, x in toxicity.maximal_segments([(i, model.lexicon[w]) for i, w in enumerate(t) if w in model.lexicon], -0.3)), default=0.0) for t in seen]
    model.k = toxicity.likeliest_k(np.array([len(t) for t in seen], float), np.array(best), model.rate)
    least = np.array([min((np.exp(e) for *_, e in toxicity.passages(model, t)), default=np.inf) for t in texts(1500)])
    for e in (0.02, 0.1, 0.5):
        assert abs((least < e).mean() - (1 - np.exp(-e))) < 0.35 * e + 0.01, (e, (least < e).mean())
    gumbel = rng.gumbel(size=20_000)  # scores whose law has K = 0.1 for n = 300 and rate 1
    assert abs(toxicity.likeliest_k(np.full(20_000, 300.0), gumbel + np.log(30), 1.0) - 0.1) < 0.005


def test_log_odds_by_hand(spark):
    import math

    rows = {"x": (3, 40), "y": (50, 2), "z": (10, 10)}
    got = {r.token: r for r in toxicity.log_odds(spark.createDataFrame([(w, *c) for w, c in rows.items()], "token string, clean long, toxic long"), 20.0, 0.5).collect()}
    for w, (c, t) in rows.items():
        a = (c + t) * 20 / 115 + 0.5
        odds = math.log((t + a) / (52 + 20 + 0.5 - t)) - math.log((c + a) / (63 + 20 + 0.5 - c))
        assert got[w].odds == pytest.approx(odds) and got[w].z == pytest.approx(odds / math.sqrt(1 / (t + a) + 1 / (c + a)))


def test_preferences_are_fitted_and_cut_at_the_quantile(spark, monkeypatch):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 3))
    good = (x @ [2.0, -1.0, 0.0] + rng.logistic(size=400) > 0).astype(int)
    table = {f"t{i}".encode(): x[i] for i in range(400)}
    monkeypatch.setattr(quality_rank, "features", lambda texts: np.array([table.get(t, np.zeros(3)) for t in texts]))
    found = __import__("pandas").DataFrame({"y": good, "x": list(x)})

    class Rows:
        def select(self, *_):
            return self

        def mapInArrow(self, *_):
            return self

        def toPandas(self):
            return found

    monkeypatch.setattr(quality_rank, "sample", lambda *a, **k: (Rows(), {0: int((good == 0).sum()), 1: int(good.sum())}))
    docs, labels = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "doc_id long, quality int")
    model = quality_rank.fit(docs, labels, F.lit(True), pairs=4000, ridge=1e-6)
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    a, b = np.flatnonzero(good == 1), np.flatnonzero(good == 0)
    d = (z[a][:, None] - z[b][None]).reshape(-1, 3)  # all pairs, by plain gradient steps
    w = np.zeros(3)
    for _ in range(3000):
        w += 2 * (d * (1 / (1 + np.exp(d @ w)))[:, None]).mean(axis=0)
    assert np.dot(w, model.weights) / np.linalg.norm(w) / np.linalg.norm(model.weights) > 0.99 and abs(np.linalg.norm(model.weights) / np.linalg.norm(w) - 1) < 0.2
    share = (model.score(x) >= 0.5).mean()
    assert abs(share - good.mean()) <= 0.01  # as many above the threshold as are good


def held_out(spark, f, label, parts, rest):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = f.fit(docs, labels, ~crc_share(F.col("doc"), parts, rest))
    out = f.score(docs, model).join(labels, "doc_id").where(crc_share(F.col("doc_id"), parts, rest)).toPandas()
    return out["score"].to_numpy(), out[label].to_numpy()


def auc(score, y):
    rank = np.argsort(np.argsort(score, kind="stable"), kind="stable") + 1
    return (rank[y == 1].sum() - (y == 1).sum() * ((y == 1).sum() + 1) / 2) / ((y == 1).sum() * (y == 0).sum())


def test_toxicity_on_held_out_rows(spark):
    s, y = held_out(spark, toxicity, "toxic", 4, 2)
    assert auc(s, y) > 0.85 and s.min() >= 0 and s.max() <= 1
    assert (s[y == 1] >= 0.3).mean() > 0.75 and (s[y == 0] >= 0.3).mean() < 0.02


def test_quality_on_held_out_rows(spark):
    s, y = held_out(spark, quality_rank, "quality", 3, 1)
    assert auc(s, y) > 0.98 and ((s >= 0.5) == (y == 1)).mean() > 0.97


@pytest.mark.parametrize("f", [toxicity, quality_rank])
def test_classifiers_on_odd_rows(spark, odd_rows, f):
    label = "toxic" if f is toxicity else "quality"
    labels = spark.createDataFrame([(1, 1), (5, 0), (7, 0), (6, 1), (None, 1), (3, None), (5, 0)], f"doc_id long, {label} int")
    for own in (labels, labels.where(f"{label} = 1"), labels.limit(0)):
        out = f.score(odd_rows, f.fit(odd_rows, own, F.lit(True))).collect()
        assert len(out) == odd_rows.count() and all(0 <= r.score <= 1 for r in out)
    assert f.score(odd_rows.limit(0), f.fit(odd_rows, labels, F.lit(True))).count() == 0


def test_features_do_not_depend_on_the_batch():
    texts = [b"", b"a b c", b"A! b| 9 a b c a b c\nx\nx\n", "é ü".encode(), b"the the the the"]
    alone = np.concatenate([quality_rank.features([t]) for t in texts])
    assert np.allclose(quality_rank.features(texts), alone)


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("", ""),
        ("a <b>b</b>c", "a bc"),
        ("<p>a<p>b", "a\n\nb"),
        ("<title>t</title><div>a</div><div>b</div>", "a\nb"),
        ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", "- a\n- b\n  - c\n- d"),
        ("<ol start=9><li>a<li>b</ol>", "9. a\n10. b"),
        ("<table><tr><th>k<th>v<tr><td>long one<td>1<tr><td>x<td>22</table>", "k         v\nlong one  1\nx         22"),
        ("<table><tr><td colspan=2>wide cell<td>z<tr><td>a<td>b<td>c</table>", "wide  cell  z\na     b     c".replace("wide  cell  z", "wide cell  z").replace("a     b     c", "a  b  c")),
        ("<pre>a\n  b</pre>", "a\n  b"),
        ("x<script>var t='</p>';</script>y<style>p{}</style><!-- z -->", "xy"),
        ("<div hidden>a</div><p style='display : none'>b<span>c</span></p><p>d", "d"),
        ("<details><summary>s</summary>no</details><details open><summary>t</summary>yes</details>", "s\nt\nyes"),
        ("a&amp;b &lt;c&gt; &eacute;&#233; &nope;", "a&b <c> éé &nope;"),
        ("one<br>two<br><br>three", "one\ntwo\n\nthree"),
        ("<blockquote>q<p>r</blockquote>", "> q\n>\n> r"),
        ("<dl><dt>T<dd>D</dl>", "T\n  D"),
        ("<p>cut <b", "cut"),
        ("</p></div>a<//>", "a"),
        ('<a title="x>y" href=z>k</a>', "k"),
        ("<textarea> <b> </textarea>", "<b>"),
        ("1 < 2 and 3 > 2", "1 < 2 and 3 > 2"),
        ("<ol start=2003><li>a<li value=-5>b<li>c</ol>", "2003. a\n-5. b\n-4. c"),
        ("<div style='visibility:hidden'>a <b style='visibility: visible'>b</b> c<p style=visibility:visible>d</div>", "b\n\nd"),
        ("<table><tr><td rowspan=2>a<td>b<td>c<tr><td>d<td>e<tr><td>f<td>g<td>h</table>", "a  b  c\n   d  e\nf  g  h"),
        ("<font>" * 300 + "<table><tr><td>a<td>b<tr><td>cc<td>d</table>", "a   b\ncc  d"),
        ("<table><tr><td>a<table><tr><td>i<tr><td>j</table><td>b<tr><td>c</table>", "a\n\ni   b\nj\nc".replace("a\n\ni   b\nj", "a  b\n\ni\nj")),
        ("<table><thead><tr><th>k<tbody><tr><td>v</table>", "k\nv"),
    ],
)
def test_layout(html, text):
    got = render(html)
    if "colspan" in html:
        assert [line.split() for line in got.split("\n")] == [["wide", "cell", "z"], ["a", "b", "c"]]
    else:
        assert got.strip() == text.strip()


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("<p>so <math><mi>x</mi><mo>=</mo><mn>2</mn></math>", "so x=2"),
        ("<math><semantics><mfrac><mn>1</mn><mn>2</mn></mfrac><annotation encoding=tex>frac</annotation></semantics></math>.", "1 2 ."),
        ("a<svg><title>t</title><desc>d</desc><defs><text>u</text></defs><rect/><g>no<text x=1>North</text><text>South</text></g></svg>b", "a North South b"),
        ("<svg><style/><text>k<tspan>m</tspan></text></svg><desc>n</desc>", "km n"),
        ("<table><tr><td colspan=99999999>wide<tr><td>x<td>y</table>", "wide\nx  y"),
        ("<map name=m><p>plan <a href=x>door</a><area></map>", "plan door"),
        ("in <select><option>red<option selected>green<option>blue</select>now", "in green now"),
        ("<select><option disabled>pick<optgroup label=g><option>one</optgroup><option>two</select>", "one"),
        ("<select multiple><option>a<option>b</select>", "a\nb"),
        ("<select><option label=L>x</select><select></select>", "L"),
        ("go<input type=submit value=Send><input type=hidden value=h><input value='typed &amp; kept'><input type=checkbox value=c><input hidden value=z>", "go Send typed & kept"),
    ],
)
def test_formulas_drawings_and_controls(html, text):
    assert render(html).strip() == text


class Words(HTMLParser):
    """Visible words in order, by another parser, for pages of the kinds in the tables."""

    def __init__(self):
        super().__init__()
        self.out, self.skip = [], 0

    def handle_starttag(self, tag, attrs):
        self.skip += tag in ("script", "style", "title")
        if tag in ("p", "li", "br", "div", "h1", "td"):
            self.out.append(" ")

    def handle_endtag(self, tag):
        self.skip -= tag in ("script", "style", "title")
        if tag in ("li", "p", "div", "h1", "ul", "nav", "article", "footer"):
            self.out.append(" ")

    def handle_data(self, data):
        if not self.skip:
            self.out.append(data)


def test_all_visible_words_in_order(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r.text for r in html_layout.extract(pages).collect()}
    for r in pages.collect():
        w = Words()
        w.feed(r.html)
        w.close()
        words = [x for x in re.sub(r"(?m)^\s*(- |> )", "", got[r.page_id]).split() if x != "-"]
        assert words == [x for x in "".join(w.out).split() if x != "-"], r.page_id


def test_html_edges(spark):
    import time

    began = time.time()
    for tag in ("div", "b", "li", "td", "p", "font", "table", "svg"):
        assert render(f"<{tag}>" * 30_000 + "deep").replace("- ", "").strip() in ("deep", "")
    assert render("<div>" * 100_000 + "x" + "</div>" * 100_000) == "x" and time.time() - began < 60
    assert render("<div>" * 5000 + "deep") == "deep" and render("<b>" * 5000 + "x") == "x"
    rows = [(1, "u", None), (None, None, ""), (2, "u", "<p>" + "a b " * 100_000), (2, "u", "<p>x"), (2, "u", "<p>x")]
    got = html_layout.extract(spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"id": F.lit(1), "text": F.lit("t")})).collect()
    assert [r.text for r in got][:2] == [None, ""] and len(got) == 5
    assert html_layout.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_all_training_rows_and_pairs_count(spark, monkeypatch):
    rng = np.random.default_rng(6)
    monkeypatch.setattr(quality_rank, "features", lambda texts: np.zeros((len(texts), 3)))
    x = rng.normal(size=(500, 3)) * [1, 3, 0.2] + [0, 5, 1]
    good = (x @ [2.0, -0.5, 1.0] + rng.logistic(size=500) > 0).astype(int)
    found = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "doc_id int, x array<double>")
    rows = [(i, int(y)) for i, y in enumerate(good)]
    labels = spark.createDataFrame([*rows, *rows[:9], (3, None), (None, 1), (9999, 0)], "doc_id int, quality int")
    model = quality_rank.fit_all(found, labels, F.col("doc") % 5 > 0)
    own = np.arange(500) % 5 > 0
    z = (x - x[own].mean(axis=0)) / x[own].std(axis=0)
    a, b = np.flatnonzero(own & (good == 1)), np.flatnonzero(own & (good == 0))
    d = (z[a][:, None] - z[b][None]).reshape(-1, 3)  # every pair, by plain gradient steps
    w = np.zeros(3)
    for _ in range(2000):
        w += 2 * ((d * (1 / (1 + np.exp(d @ w)))[:, None]).mean(axis=0) - w / 60_000)
    assert np.allclose(model.weights, w, atol=2e-3)
    s = np.sort((x[own] - model.centre) / model.scale @ model.weights)
    assert model.threshold == pytest.approx((s[len(b) - 1] + s[len(b)]) / 2, abs=1e-9)
    scored = {r.doc_id: r.score for r in quality_rank.score_vectors(found, model).collect()}
    assert len(scored) == 500 and sum(scored[i] >= 0.5 for i in np.flatnonzero(own)) == len(a)
    for one, wanted in ((1, 1.0), (0, 0.0), (None, 0.5)):
        some = labels.where(F.col("quality") == one if one is not None else F.lit(False))
        alone = quality_rank.score_vectors(found, quality_rank.fit_all(found, some, F.lit(True)))
        assert {round(r.score, 6) for r in alone.collect()} == {wanted}


@pytest.mark.parametrize("most", [3, 10_000])
def test_ranks_are_exact(spark, most):
    rng = np.random.default_rng(7)
    for s in (rng.normal(size=300), rng.integers(0, 4, 300) * 1.0, np.r_[np.full(299, 2.0), 1e9]):
        frame, s = spark.createDataFrame([(float(v),) for v in s], "s double"), np.sort(s)
        for k in (1, 120, 299, 300):
            assert quality_rank._around(frame, k, 300, most) == (s[k - 1], s[min(k, 299)])
