"""Quality rules: base statistics and robust multivariate outliers.

Each document that passes the base rules gives a vector of transformed
statistics. Per language and source, a minimum-covariance-determinant estimate
(location and covariance of the most concentrated half of the rows, so that up
to half of a group may be junk) is found by concentration steps from two starts,
medians with median deviations and plain moments, until no determinant falls any
more; the start that ends with the smaller determinant counts. One reweighting
step takes the moments of all rows within the 97.5 % ellipsoid of that estimate.
A document whose Mahalanobis distance by them is above the cutoff is rejected.

All work is aggregation over a small table of statistics with map-side
combine; quantiles come from mergeable sketches of bounded size, so a source
with a third of all rows needs no large task. Only DataFrame functions are used.
"""

from __future__ import annotations

import functools
import math
import operator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barline.llm.common import SPACES, full_text, has_cold, join_hot_cold, let, materialize, release, squeeze, words

# Fixed value: the characters that count as symbols.
SYMBOLS = "#*$%&|<>"
WINDOW = 5
DIM = 4
#: Standard deviations below which a statistic's spread is never taken.
FLOORS = (0.06, 0.30, 0.05, 0.04)
#: Squared distance above which a document is rejected (chi-square, 4 degrees, about 1 in 10 million).
CUTOFF = 40.0
#: The half of the rows that the determinant is taken over: the estimate holds with up to half junk.
SHARE = 0.5
#: Steps end when no determinant falls; this many are never needed.
MOST_STEPS = 50
#: Share of clean rows that the reweighted moments cover, and its chi-square quantile (4 degrees).
INNER, INNER_D2 = 0.975, 11.1433
ACCURACY = 10_000


def repeat_words(ws: Column) -> Column:
    """Words in WINDOW-word windows that occur twice or more in the array."""
    windows = F.transform(F.slice(ws, 1, F.greatest(F.size(ws) - (WINDOW - 1), F.lit(0))), lambda x, i: F.xxhash64(x, *[F.get(ws, i + k) for k in range(1, WINDOW)]))

    def covered(h):
        def positions(s):
            def twin(e, k):
                same = lambda other: F.coalesce(F.get(s, other)["h"] == e["h"], F.lit(False))
                return same(k - 1) | same(k + 1)

            return F.sort_array(F.transform(F.filter(s, twin), lambda e: e["i"]))

        def length(pos):
            steps = F.transform(pos, lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get(pos, k + 1) - p, F.lit(WINDOW))))
            return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)

        ordered = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(let(ordered, lambda s: let(positions(s), length)))

    return let(windows, covered)


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    text = full_text(text_col)
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    per_words = let(words(text), lambda ws: F.struct(F.size(ws).cast("long").alias("n_words"), repeat_words(ws).alias("n_repeat_words")))
    per_lines = let(lines, lambda ls: F.struct(F.size(ls).cast("long").alias("n_lines"), (F.size(ls) - F.size(F.array_distinct(ls))).cast("long").alias("n_dup_lines")))
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(lang_col).cast("string").alias("lang"),
        F.col(source_col).cast("string").alias("source"),
        F.length(squeeze(text)).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        per_words.alias("w"),
        per_lines.alias("l"),
    )
    rows = rows.select("doc_id", "lang", "source", "word_chars", "n_symbols", "w.*", "l.*")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return rows.withColumn("base_failed", failed)


def vectors(stats: DataFrame) -> DataFrame:
    """Adds x0..x3: shares damped for short texts, on scales where clean texts are near normal."""
    n = F.col("n_words")
    return stats.withColumns(
        {
            "x0": F.log((F.col("word_chars") + 150.0) / (n + 30.0)),
            "x1": F.log1p(100.0 * F.col("n_symbols") / (n + 30.0)),
            "x2": F.col("n_dup_lines") / (F.col("n_lines") + 5.0),
            "x3": F.col("n_repeat_words") / (n + 30.0),
        }
    )


def _factor_step(params: DataFrame) -> DataFrame:
    """Replaces c_i_j (covariances) by l_i_j (their factor) and logdet, row by row.

    One select per row of the factor keeps the expressions small.
    """
    out = params
    for i in range(DIM):
        for j in range(i + 1):
            rest = functools.reduce(operator.sub, [F.col(f"l{i}{k}") * F.col(f"l{j}{k}") for k in range(j)], F.col(f"c{i}{j}"))
            out = out.withColumn(f"l{i}{j}", F.sqrt(F.greatest(rest, F.lit(1e-9))) if i == j else rest / F.col(f"l{j}{j}"))
    logdet = functools.reduce(operator.add, [2 * F.log(F.col(f"l{i}{i}")) for i in range(DIM)])
    return out.withColumn("logdet", logdet).drop(*[f"c{i}{j}" for i in range(DIM) for j in range(i + 1)])


def _distance(rows: DataFrame) -> DataFrame:
    """Adds d2, the squared Mahalanobis distance by m_i and l_i_j, by forward substitution."""
    for i in range(DIM):
        rest = functools.reduce(operator.sub, [F.col(f"l{i}{k}") * F.col(f"y{k}") for k in range(i)], F.col(f"x{i}") - F.col(f"m{i}"))
        rows = rows.withColumn(f"y{i}", rest / F.col(f"l{i}{i}"))
    return rows.withColumn("d2", functools.reduce(operator.add, [F.col(f"y{i}") * F.col(f"y{i}") for i in range(DIM)])).drop(*[f"y{i}" for i in range(DIM)])


def _consistency(share: float) -> float:
    """Factor that makes the covariance of the most central share unbiased for normal data."""
    tail = lambda q, terms: math.exp(-q / 2) * sum((q / 2) ** k / math.factorial(k) for k in range(terms))
    lo, hi = 0.0, 100.0
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if 1 - tail(mid, DIM // 2) < share else (lo, mid)
    return share / (1 - tail(lo, DIM // 2 + 1))


def robust_groups(vecs: DataFrame, min_rows: int = 50) -> DataFrame:
    """Adds ``grp`` and ``levels``.

    ``grp``, the label of the estimate a row is judged by, is (lang, source), or
    lang alone, or all, whichever has ``min_rows`` rows first; ``levels`` has all
    labels in use that the row feeds, whichever it is judged by.
    """
    label = lambda level, lang=F.lit(None), source=F.lit(None): F.to_json(F.struct(F.lit(level).alias("level"), lang.cast("string").alias("lang"), source.cast("string").alias("source")))
    by_source = vecs.groupBy("lang", "source").agg(F.count("*").alias("n"))
    by_source = by_source.withColumn("n_lang", F.sum("n").over(Window.partitionBy("lang")))
    by_source = by_source.withColumn("level", F.when(F.col("n") >= min_rows, 1).when(F.col("n_lang") >= min_rows, 2).otherwise(3))
    by_source = by_source.withColumn("lang_used", F.max(F.col("level") == 2).over(Window.partitionBy("lang")))
    by_source = by_source.crossJoin(F.broadcast(by_source.agg((F.max("level") == 3).alias("all_used"))))
    labels = F.array(label(1, F.col("lang"), F.col("source")), label(2, F.col("lang")), label(3))
    used = F.array(F.col("level") == 1, F.col("lang_used"), F.col("all_used"))
    levels = F.array_compact(F.zip_with(labels, used, lambda x, u: F.when(u, x)))
    by_source = by_source.select(F.col("lang").alias("g1"), F.col("source").alias("g2"), F.get(labels, F.col("level") - 1).alias("grp"), levels.alias("levels"))
    return vecs.join(by_source, vecs["lang"].eqNullSafe(by_source["g1"]) & vecs["source"].eqNullSafe(by_source["g2"]), "left").drop("g1", "g2")


def mcd(rows: DataFrame, share: float = SHARE) -> DataFrame:
    """One row per ``grp``: n_rows, m0.., l00.., the reweighted estimate with the least determinant.

    ``rows`` (materialized) has grp and x0..x3.
    """
    xs = range(DIM)
    pairs = [(i, j) for i in xs for j in range(i + 1)]
    cov = lambda i, j, scale=1.0: (scale * F.coalesce(F.covar_pop(f"x{i}", f"x{j}"), F.lit(0.0)) + (FLOORS[i] ** 2 if i == j else 0.0)).alias(f"c{i}{j}")
    moments = lambda scale=1.0: [*[F.avg(f"x{i}").alias(f"m{i}") for i in xs], *[cov(i, j, scale) for i, j in pairs]]
    size, total = F.count("*").alias("n_rows"), rows.count()
    plain = rows.groupBy("grp").agg(size, *moments())
    medians = rows.groupBy("grp").agg(size, *[F.percentile_approx(f"x{i}", 0.5, ACCURACY).alias(f"m{i}") for i in xs])
    medians = materialize(medians)
    cold = has_cold(medians, "n_rows", total)
    spread = join_hot_cold(rows, medians, ["grp"], "n_rows", total, cold=cold).groupBy("grp").agg(
        size, *[F.first(f"m{i}").alias(f"m{i}") for i in xs], *[F.percentile_approx(F.abs(F.col(f"x{i}") - F.col(f"m{i}")), 0.5, ACCURACY).alias(f"s{i}") for i in xs]
    )
    spread = spread.select(
        "grp", "n_rows", *[f"m{i}" for i in xs], *[(F.pow(1.4826 * F.col(f"s{i}"), 2) + FLOORS[i] ** 2 if i == j else F.lit(0.0)).alias(f"c{i}{j}") for i, j in pairs]
    )
    params = plain.withColumn("start", F.lit(0)).unionByName(spread.withColumn("start", F.lit(1)))
    params = materialize(_factor_step(params).withColumn("logdet", F.lit(float("inf"))))
    for _ in range(MOST_STEPS):
        far = _distance(join_hot_cold(rows, params, ["grp"], "n_rows", total, cold=cold)).select("grp", "start", "d2", F.col("logdet").alias("before"), *[f"x{i}" for i in xs])
        limit = materialize(far.groupBy("grp", "start").agg(size, F.percentile_approx("d2", share, ACCURACY).alias("q")))
        core = join_hot_cold(far, limit, ["grp", "start"], "n_rows", total, cold=cold).filter("d2 <= q")
        core = core.groupBy("grp", "start").agg(F.first("n_rows").alias("n_rows"), F.first("before").alias("before"), *moments(_consistency(share)))
        params = materialize(_factor_step(core))
        release(rows.sparkSession)
        if params.filter("before - logdet > 1e-6").isEmpty():
            break
    best = params.groupBy("grp").agg(F.min_by("start", F.struct("logdet", "start")).alias("start"))
    raw = materialize(params.join(best, ["grp", "start"]).drop("start", "logdet", "before"))
    inner = _distance(join_hot_cold(rows, raw, ["grp"], "n_rows", total, cold=cold)).filter(F.col("d2") <= INNER_D2)
    return _factor_step(inner.groupBy("grp").agg(F.first("n_rows").alias("n_rows"), *moments(_consistency(INNER)))).drop("logdet")


def quality(docs: DataFrame, cutoff: float = CUTOFF, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """One row per input row: the base statistics, base_failed, kept and distance2.

    Defined cases: a null text has no words and fails the base rules; a text
    that fails them takes no part in the estimates and has no distance; null
    languages and sources are values of their own; groups with under 50 texts
    that pass use the estimate of all such rows of their language, or of all;
    repeated rows count as often as they come; an empty table gives an empty
    result; further columns are ignored.
    """
    stats = materialize(statistics(docs, id_col, text_col, lang_col, source_col))
    rows = materialize(robust_groups(vectors(stats.filter("not base_failed"))))
    members = materialize(rows.select(F.explode("levels").alias("grp"), *[f"x{i}" for i in range(DIM)]))
    estimates, total = materialize(mcd(members)), rows.count()
    judged = _distance(join_hot_cold(rows, estimates, ["grp"], "n_rows", total, cold=has_cold(estimates, "n_rows", total)))
    out = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    judged = judged.select(*out, (F.col("d2") <= cutoff).alias("kept"), F.col("d2").alias("distance2"))
    failed = stats.filter("base_failed").select(*out, F.lit(False).alias("kept"), F.lit(None).cast("double").alias("distance2"))
    return judged.unionByName(failed)
