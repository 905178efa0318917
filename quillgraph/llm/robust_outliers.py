"""Quality rules: robust multivariate outliers by minimum covariance determinant, per language and source.

Each document becomes a vector of transformed statistics (log mean word length; square roots of the shares of symbols, of repeated
lines, of words in repeated 8-word windows, of capitals, of words equal to the one before). Per group, concentration steps seek the `share` of rows whose
covariance determinant is least: distances under the current estimate, the nearest share of rows, their mean and covariance, and again until no
group's determinant falls any more. They run from three starts (medians and quartiles; all rows; the half nearest to the first start), and the estimate with
the least determinant is kept. Documents too far from it by Mahalanobis distance are rejected.

Groups with fewer than `least_rows` usable rows take their language's estimate, small languages that of all rows; with
fewer rows still nothing is rejected. Only estimates that some group takes are made. A floor on each statistic's scale keeps statistics that are zero in nearly all
documents from making every other document an outlier. Floors bound what a statistic adds to a squared distance, by (range / floor)²: any
statistic can pass the cut (38.26 at the default level) by itself but q_repeat, which the base rule bounds. Repeats by themselves are
judged by the base rule (30 % of the words); under it they add at most 4.8.

All of it is aggregation and equi-joins of built-in functions. A concentration step is one pass for all groups and starts: counts and moments by (group, start,
distance bin), combined before the shuffle, so a group with a third of all rows costs no task more than the others; the nearest
share is whole bins. What is collected is one number a step.

Null text counts as empty and fails the base rule. Null languages and sources are groups like others. Repeated rows count each, rows at equal distances are
taken or left together. Texts of any length are read whole; an empty table gives an empty result. No other column is read, and columns of any names may be there.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.plans.scratch import stored

SPACE = r"[\x20\x09-\x0D]+"
#: Statistic -> the least scale its distances are measured in.
FLOORS = {"q_length": 0.08, "q_symbols": 0.04, "q_lines": 0.14, "q_repeat": 0.25, "q_capitals": 0.04, "q_stutter": 0.12}
STATS = list(FLOORS)
P = len(STATS)
_BIN, _DISTANCE_BIN = 0.01, 50.0


def chi2_cdf(x: float, k: int) -> float:
    """Of the chi-square distribution, by the series of the incomplete gamma function."""
    a, h = k / 2, x / 2
    term = total = 1 / a
    for i in range(1, 500):
        term *= h / (a + i)
        total += term
    return min(1.0, total * math.exp(a * math.log(h) - h - math.lgamma(a))) if h > 0 else 0.0


def chi2_quantile(q: float, k: int) -> float:
    low, high = 0.0, 400.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_cdf(mid, k) < q else (low, mid)
    return high


def _let(value: Column, body) -> Column:
    """body(value) with value computed once a row."""
    return F.transform(F.array(value), body)[0]


def _covered(hashes: Column) -> Column:
    """The number of words in 8-word windows whose hash occurs twice or more: sorted (hash, position) pairs, the positions with an
    equal neighbour, in order; each covers min(8, distance to the next) words, the last one 8."""

    def repeated(s: Column) -> Column:
        same = lambda x, j: F.coalesce(F.get(s, j)["h"] == x["h"], F.lit(False))
        return F.sort_array(F.transform(F.filter(s, lambda x, i: same(x, i - 1) | same(x, i + 1)), lambda x: x["i"]))

    def words(at: Column) -> Column:
        gaps = F.transform(at, lambda p, i: F.least(F.lit(8), F.coalesce(F.get(at, i + 1) - p, F.lit(8))))
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda n, g: n + g)

    pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return _let(_let(pairs, repeated), words)


def _repeat_words(words: Column) -> Column:
    n = F.size(words) - 7
    hashes = F.when(n > 1, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.xxhash64(F.slice(words, i, 8)))).otherwise(F.array().cast("array<long>"))
    return _let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(_covered(h)))


def statistics(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """docs with a column `quality`: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed and
    the transformed statistics."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    by_words = _let(
        words,
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.aggregate(w, F.lit(0).cast("long"), lambda n, x: n + F.char_length(x)).alias("word_chars"),
            _repeat_words(w).alias("n_repeat_words"),
            F.size(F.filter(w, lambda x, i: (i > 0) & (x == F.get(w, i - 1)))).cast("long").alias("n_stutter"),
        ),
    )
    by_lines = _let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    n_symbols = F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long")
    n_capitals = F.regexp_count(text, F.lit(r"\p{Lu}")).cast("long")

    def whole(w: Column) -> Column:
        n, chars = w["n_words"], F.greatest(w["word_chars"], F.lit(1))
        share = lambda part, of: F.sqrt(part / F.greatest(of, F.lit(1)))
        facts = [w["n_words"].alias("n_words"), w["word_chars"].alias("word_chars"), w["n_symbols"].alias("n_symbols"), w["n_dup_lines"].alias("n_dup_lines"), w["n_repeat_words"].alias("n_repeat_words")]
        failed = (n < 20) | (w["n_repeat_words"] * 100 > n * 30)
        moved = [F.ln(chars / F.greatest(n, F.lit(1))), share(w["n_symbols"], chars), share(w["n_dup_lines"], w["n_lines"]), share(w["n_repeat_words"], n), share(w["n_capitals"], chars), share(w["n_stutter"], n)]
        return F.struct(*facts, failed.alias("base_failed"), *[x.alias(s) for x, s in zip(moved, STATS, strict=True)])

    raw = _let(
        F.struct(by_words.alias("w"), by_lines.alias("x"), n_symbols.alias("n_symbols"), n_capitals.alias("n_capitals")),
        lambda r: F.struct(
            *[r["w"][c].alias(c) for c in ("n_words", "word_chars", "n_repeat_words", "n_stutter")], *[r["x"][c].alias(c) for c in ("n_lines", "n_dup_lines")], r["n_symbols"].alias("n_symbols"), r["n_capitals"].alias("n_capitals")
        ),
    )
    return docs.withColumn("quality", _let(raw, whole))


def _key(level: int, lang: Column, source: Column) -> Column:
    return F.struct(F.lit(level).alias("level"), lang.alias("lang"), source.alias("source"))


def _keys(lang: Column, source: Column) -> list[Column]:
    """The groups that a row belongs to, the narrowest first; a key is (level, language, source)."""
    none = F.lit(None).cast("string")
    return [_key(0, lang, source), _key(1, lang, none), _key(2, none, none)]


def _sent(model: DataFrame, most: int = 20_000) -> DataFrame:
    """The model, to be sent to all tasks if it has at most `most` rows (a few hundred bytes each), so that no row of a hot group moves; a
    larger one is joined by key, and adaptive joins split the keys that many rows have."""
    return F.broadcast(model) if model.count() <= most else model


def _wanted(rows: DataFrame, least_rows: int) -> DataFrame:
    """(key, n): the groups whose estimate some row takes: those with least_rows rows, languages with least_rows rows that have a smaller group, and
    the whole if there are smaller languages among these (and rows enough)."""
    none = F.lit(None).cast("string")
    groups = stored(rows.groupBy("lang", "source").agg(F.count("*").alias("n")), "mcd-groups")
    langs = groups.groupBy("lang").agg(F.sum("n").alias("n"), F.min("n").alias("least")).where(F.col("least") < least_rows)
    whole = groups.agg(F.sum("n").alias("n")).join(langs.agg(F.min("n").alias("least")), F.lit(True))  # one row each
    enough = F.col("n") >= least_rows
    out = groups.where(enough).select(_key(0, F.col("lang"), F.col("source")).alias("key"), "n")
    out = out.unionByName(langs.where(enough).select(_key(1, F.col("lang"), none).alias("key"), "n"))
    return out.unionByName(whole.where(enough & (F.col("least") < least_rows)).select(_key(2, none, none).alias("key"), "n"))


# The long sums below are written as SQL text: each becomes a column by one call, where building it operator by operator costs hundreds. Statistics are
# measured in their floors, the same for all groups, so a step's tables hold an estimate and nothing else: every step is planned anew, and wide plans fill the driver.
_CELLS = [(i, j) for i in range(P) for j in range(i + 1)]
_Z = [f"{s} / {floor!r}D" for s, floor in FLOORS.items()]
_MEANS = [f"mu_{i}" for i in range(P)]


def _inverted(table: DataFrame, kept: list[str], covariance: dict[tuple[int, int], str]) -> DataFrame:
    """The kept columns with log_det, the logarithm of the covariance's determinant, and w_i_j, its inverse: one sweep (a Gauss-Jordan step in place) for each
    statistic, over an array of the rows of the matrix."""
    matrix = ", ".join(f"array({', '.join(f'v_{max(i, j)}_{min(i, j)}' for j in range(P))})" for i in range(P))
    cell = "if(i = k and j = k, -1 / pivot, if(i = k or j = k, x / pivot, x - a.m[i][k] * a.m[j][k] / pivot))"
    swept = f"named_struct('log_det', a.log_det + ln(pivot), 'm', transform(a.m, (r, i) -> transform(r, (x, j) -> {cell})))"
    sweep = f"(a, k) -> transform(array(greatest(a.m[k][k], 1e-12D)), pivot -> {swept})[0]"
    table = table.selectExpr(*kept, *[f"{covariance[i, j]} as v_{i}_{j}" for i, j in _CELLS])
    table = table.selectExpr(*kept, f"aggregate(sequence(0, {P - 1}), named_struct('log_det', 0D, 'm', array({matrix})), {sweep}) as swept")
    return table.selectExpr(*kept, "swept.log_det as log_det", *[f"-swept.m[{i}][{j}] as w_{i}_{j}" for i, j in _CELLS])


def distance2() -> Column:
    """Squared Mahalanobis distance of the statistics' columns under the model's columns mu_i, w_i_j (inverse covariance): one flat sum over pairs of
    statistics."""
    terms = " + ".join(f"{1 if i == j else 2} * w_{i}_{j} * z[{i}] * z[{j}]" for i, j in _CELLS)
    return F.expr(f"transform(array(array({', '.join(f'{z} - mu_{i}' for i, z in enumerate(_Z))})), z -> {terms})[0]")


def _scaling(rows: DataFrame) -> DataFrame:
    """The first model: medians and, without correlations, scales by quartiles, from counts of narrow bins; no scale is under its floor."""
    long = rows.select("key", F.posexplode(F.array(*[F.floor(F.col(s) / _BIN).cast("int") for s in STATS])).alias("i", "bin"))
    counts = long.groupBy("key", "i", "bin").agg(F.count("*").alias("c"))
    ranked = counts.withColumn("upto", F.sum("c").over(Window.partitionBy("key", "i").orderBy("bin"))).withColumn("all", F.sum("c").over(Window.partitionBy("key", "i")))
    at = lambda q: F.min(F.when(F.col("upto") >= F.ceil(F.col("all") * q), (F.col("bin") + 0.5) * _BIN))
    quartiles = ranked.groupBy("key", "i").agg(at(0.25).alias("q1"), at(0.5).alias("q2"), at(0.75).alias("q3"))
    floor = F.element_at(F.array(*map(F.lit, FLOORS.values())), F.col("i") + 1)
    scaled = quartiles.select("key", "i", (F.col("q2") / floor).alias("mu"), F.greatest((F.col("q3") - F.col("q1")) / 1.349 / floor, F.lit(1.0)).alias("s"))
    of = lambda i, x: F.max(F.when(F.col("i") == i, x))
    model = scaled.groupBy("key").agg(F.sum(2 * F.ln("s")).alias("log_det"), *[of(i, F.col("mu")).alias(f"mu_{i}") for i in range(P)], *[of(i, 1 / (F.col("s") * F.col("s"))).alias(f"w_{i}_{i}") for i in range(P)])
    return model.select("key", F.lit(0).alias("start"), *_MEANS, "log_det", *[F.col(f"w_{i}_{j}") if i == j else F.lit(0.0).alias(f"w_{i}_{j}") for i, j in _CELLS])


def _binned(rows: DataFrame, model: DataFrame) -> DataFrame:
    """(key, start, bin, c, moments, before, n): counts and sums of the rows under each estimate, by bins of distance."""
    named = rows.withColumnRenamed("key", "row_key").join(model, F.col("row_key") == F.col("key"))
    each = named.select("key", "start", F.floor(F.log1p(distance2()) * _DISTANCE_BIN).cast("int").alias("bin"), *[F.expr(f"{z} as z_{i}") for i, z in enumerate(_Z)])
    sums = [F.count("*").alias("c"), *[F.expr(f"sum(z_{i}) as a_{i}") for i in range(P)], *[F.expr(f"sum(z_{i} * z_{j}) as b_{i}_{j}") for i, j in _CELLS]]
    group = Window.partitionBy("key", "start")
    return each.groupBy("key", "start", "bin").agg(*sums).withColumn("before", F.sum("c").over(group.orderBy("bin")) - F.col("c")).withColumn("n", F.sum("c").over(group))


def _consistent(share: float) -> float:
    """The consistency factor of the nearest share's covariance."""
    return share / chi2_cdf(chi2_quantile(share, P), P + 2) if share < 1 else 1.0


def _estimate(near: DataFrame, grow: str) -> DataFrame:
    """The model from the bins of each group's nearest share: mean, covariance made consistent, its inverse. No scale is under the statistic's floor."""
    moments = [f"a_{i}" for i in range(P)] + [f"b_{i}_{j}" for i, j in _CELLS]
    total = near.groupBy("key", "start").agg(*[F.expr(f"sum({c}) as {c}") for c in ("c", *moments)])
    total = total.selectExpr("key", "start", *[f"a_{i} / c as mu_{i}" for i in range(P)], *[f"b_{i}_{j} / c as b_{i}_{j}" for i, j in _CELLS])
    return _inverted(total, ["key", "start", *_MEANS], {(i, j): f"(b_{i}_{j} - mu_{i} * mu_{j}) * {grow}" + (" + 1" if i == j else "") for i, j in _CELLS})


def fit(stats: DataFrame, *, share: float = 0.75, trial_steps: int = 2, most_steps: int = 10, least_rows: int = 60) -> DataFrame:
    """The model: a row for each group that _wanted() names; stats has lang, source, base_failed and the statistics. After trial_steps each group
    goes on with its start of least determinant, until no group's determinant falls by a hundredth any more, most_steps at the latest. log_det is
    relative to that of the scales by quartiles."""
    rows = stats.where("not base_failed")
    many = stored(_wanted(rows, least_rows), "mcd-wanted")
    starts = {0: share, 1: 1.0, 2: 0.5}
    send = F.broadcast if many.count() * len(starts) <= 20_000 else lambda model: model  # as in _sent()
    rows = rows.select(F.explode(F.array(*_keys(F.col("lang"), F.col("source")))).alias("row_key"), *STATS).join(send(many), F.col("row_key") == F.col("key"))
    rows = stored(rows.select("key", *STATS), "mcd-rows")
    first = stored(_scaling(rows), "mcd")

    def step(model: DataFrame) -> DataFrame:
        return stored(_estimate(_binned(rows, send(model)).where(F.col("before") < F.col("n") * share), f"{_consistent(share)!r}D"), "mcd")

    tried = F.explode(F.array(*[F.struct(F.lit(k).alias("start"), F.lit(part).alias("share")) for k, part in starts.items()]))
    near = _binned(rows, send(first)).withColumn("tried", tried).where(F.col("before") < F.col("n") * F.col("tried.share")).withColumn("start", F.col("tried.start"))
    model = stored(_estimate(near, f"array({', '.join(f'{_consistent(part)!r}D' for part in starts.values())})[start]"), "mcd")
    for _ in range(trial_steps):
        model = step(model)
    best = model.groupBy("key").agg(F.min(F.struct("log_det", "start")).alias("x")).select(F.col("key").alias("k"), F.col("x.start").alias("s"))
    model = stored(model.join(best, (F.col("key") == F.col("k")) & (F.col("start") == F.col("s"))).drop("k", "s"), "mcd")
    for _ in range(most_steps):
        after = step(model)
        falls = after.join(model.select("key", F.col("log_det").alias("was")), "key").agg(F.max(F.col("was") - F.col("log_det"))).first()[0]
        model = after
        if falls is None or falls < 1e-2:
            break
    return model.join(first.select("key", F.col("log_det").alias("base")), "key").withColumn("log_det", F.col("log_det") - F.col("base")).drop("base")


def judge(stats: DataFrame, model: DataFrame, *, level: float = 1e-6) -> DataFrame:
    """stats with distance2 (null without an estimate) and kept: false if base_failed or farther than the chi-square quantile."""
    keys, model = _keys(F.col("lang"), F.col("source")), _sent(model)
    has = model.select("key", F.lit(True).alias("has"))
    out = stats
    for level_no, key in enumerate(keys[:2]):  # which estimate a row takes
        out = out.withColumn("__k", key).join(has.select(F.col("key").alias("__h"), F.col("has").alias(f"__has{level_no}")).where(F.col("__h.level") == level_no), F.col("__k") == F.col("__h"), "left").drop("__k", "__h")
    key = F.when(F.col("__has0"), keys[0]).when(F.col("__has1"), keys[1]).otherwise(keys[2])
    own = model.withColumnRenamed("key", "__h")
    out = out.withColumn("__k", key).join(own, F.col("__k") == F.col("__h"), "left")
    d2 = F.when(F.col("__h").isNotNull(), distance2())
    kept = ~F.col("base_failed") & (F.col("__h").isNull() | (d2 <= chi2_quantile(1 - level, P)))
    return out.withColumn("distance2", d2).withColumn("kept", kept).select(*stats.columns, "distance2", "kept")


def assess(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", **how) -> DataFrame:
    """One row per document: (id, lang, source, the counts, base_failed, the statistics, distance2, kept)."""
    rows = statistics(docs.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(source_col).cast("string").alias("source"), F.col(text_col).alias("text")))
    stats = stored(rows.select("id", "lang", "source", "quality.*"), "doc-stats")
    return judge(stats, fit(stats, **how)).withColumnRenamed("id", id_col)


def keep(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", **how) -> DataFrame:
    """The documents that are not rejected; columns stay as they are.

    Documents are written once with their statistics beside them: a condition on computed statistics would otherwise be pushed below
    their computation and repeat it for each of its many references.
    """
    rows = statistics(docs.select(F.struct([F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col(lang_col).cast("string").alias("lang"), F.col(source_col).cast("string").alias("source"), F.col(text_col).alias("text")))
    rows = stored(rows.select("doc", "lang", "source", "quality.*"), "doc-stats")
    return judge(rows, fit(rows.drop("doc"), **how)).where("kept").select("doc.*")
