"""Quality metrics over graded outcomes.

Outcomes have ``question, gold, predicted, agree, gradable, confidence``; binary
scores have ``score, gold_bool``.  ``by`` names grouping columns with few distinct
values.  Results are not rounded.  Rows without gold are ungradable and excluded,
never wrong.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .profile import nearest_rank
from .ranking import sum_before, sums_before

COVERAGE_CUTS = (0.5, 0.6, 0.7, 0.8, 0.85, 0.9, 0.95)
SCRIPT_CUTS = (0.5, 0.6, 0.7, 0.8, 0.85, 0.9)
ECE_BINS = 5
WILSON_Z = 1.96


def share(condition: Column) -> Column:
    """Share of rows for which a condition holds; null if there are none."""
    return F.avg(condition.cast("double"))


def count_if(condition: Column) -> Column:
    return F.count_if(condition).cast("long")


def gradable(outcomes: DataFrame) -> DataFrame:
    return outcomes.where("gradable")


def accuracy(outcomes: DataFrame, by: list[str]) -> DataFrame:
    """hits, total, ratio (0 if nothing is gradable)."""
    g = F.col("gradable")
    return outcomes.groupBy(*by).agg(
        count_if(g & F.col("agree")).alias("hits"), count_if(g).alias("total"), F.coalesce(share(F.when(g, F.col("agree"))), F.lit(0.0)).alias("ratio")
    )


def per_question(outcomes: DataFrame) -> DataFrame:
    """n, ungraded, majority share, lift over it, distinct predictions, correct, accuracy, mean confidence, overconfidence."""
    by_gold = outcomes.groupBy("question", "gold").agg(
        count_if(F.col("gradable")).alias("n"), count_if(~F.col("gradable")).alias("ungraded"), count_if(F.col("gradable") & F.col("agree")).alias("correct"),
        F.sum(F.when(F.col("gradable"), F.col("confidence"))).alias("confidence"),
    )
    distinct = gradable(outcomes).groupBy("question").agg(F.countDistinct("predicted").alias("distinct_predictions"))
    totals = by_gold.groupBy("question").agg(
        F.sum("n").alias("n"), F.sum("ungraded").alias("ungraded"), F.try_divide(F.max("n"), F.sum("n")).alias("majority"), F.sum("correct").alias("correct"),
        F.try_divide(F.sum("correct"), F.sum("n")).alias("accuracy"), F.try_divide(F.sum("confidence"), F.sum("n")).alias("mean_confidence"),
    )
    joined = totals.where("n > 0").join(distinct, "question")
    return joined.withColumn("lift", F.col("accuracy") - F.col("majority")).withColumn("overconfidence", F.col("mean_confidence") - F.col("accuracy"))


def confusion(outcomes: DataFrame, labels: list[str]) -> DataFrame:
    """One row for each gold label, one column ``pred_<label>`` for each predicted; other labels are dropped."""
    counts = [count_if(F.col("predicted") == x).alias(f"pred_{x}") for x in labels]
    grid = outcomes.sparkSession.createDataFrame([(x,) for x in labels], "gold string")
    found = gradable(outcomes).where(F.col("gold").isin(labels)).groupBy("gold").agg(*counts)
    return grid.join(found, "gold", "left").na.fill(0)


def reliability(outcomes: DataFrame, bins: int = ECE_BINS) -> DataFrame:
    """bin, n, mean confidence, accuracy of each non-empty confidence bin."""
    clipped = F.least(F.greatest(F.col("confidence"), F.lit(0.0)), F.lit(0.999999))
    b = F.floor(clipped * bins).cast("long")
    return gradable(outcomes).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg("confidence").alias("mean_confidence"), share(F.col("agree")).alias("accuracy"))


def calibration_error(outcomes: DataFrame, bins: int = ECE_BINS) -> DataFrame:
    table = reliability(outcomes, bins)
    return table.agg((F.sum(F.col("n") * F.abs(F.col("mean_confidence") - F.col("accuracy"))) / F.sum("n")).alias("ece"), F.sum("n").alias("n"))


def brier(outcomes: DataFrame, by: list[str]) -> DataFrame:
    return gradable(outcomes).groupBy(*by).agg(F.avg(F.pow(F.col("confidence") - F.col("agree").cast("double"), F.lit(2.0))).alias("brier"), F.count(F.lit(1)).alias("n"))


def _cuts(df: DataFrame, cuts: tuple[float, ...]) -> DataFrame:
    """Each row once for each of a handful of cut-offs."""
    return df.withColumn("cut", F.explode(F.array(*[F.lit(c) for c in cuts])))


def coverage_curve(outcomes: DataFrame, cuts: tuple[float, ...] = COVERAGE_CUTS) -> DataFrame:
    """Per confidence cut-off: kept, coverage, accuracy (null if nothing is kept), errors."""
    kept = F.col("confidence") >= F.col("cut")
    return _cuts(gradable(outcomes), cuts).groupBy("cut").agg(
        count_if(kept).alias("kept"), share(kept).alias("coverage"), share(F.when(kept, F.col("agree"))).alias("accuracy"), count_if(kept & ~F.col("agree")).alias("errors")
    )


def script_coverage(outcomes: DataFrame, questions: list[str], cuts: tuple[float, ...] = SCRIPT_CUTS) -> DataFrame:
    """Scripts all of whose listed questions are gradable and reach the cut-off, and the share of them that is all right."""
    listed = _cuts(outcomes.where(F.col("question").isin(questions)), cuts)
    ok = F.col("gradable") & (F.col("confidence") >= F.col("cut"))
    scripts = listed.groupBy("cut", "script").agg(F.countDistinct(F.when(ok, F.col("question"))).alias("reached"), F.bool_and(ok).alias("all_ok"), F.bool_and(F.col("agree")).alias("right"))
    kept = F.col("all_ok") & (F.col("reached") == len(questions))
    return scripts.groupBy("cut").agg(F.count(F.lit(1)).alias("scripts"), count_if(kept).alias("kept"), share(F.when(kept, F.col("right"))).alias("accuracy"))


def latency_summary(values: DataFrame, column: str) -> DataFrame:
    """n, min, p50, p95, max, total, mean of the positive values."""
    used = values.where(F.col(column) > 0).select(F.lit("all").alias("_all"), F.col(column).cast("double").alias("ms"))
    counts = used.groupBy("_all", "ms").agg(F.count(F.lit(1)).alias("c"))
    ranked = sum_before(counts, ["_all"], ["ms"], "c", "before")
    total = counts.groupBy("_all").agg(F.sum("c").alias("n"), F.min("ms").alias("min"), F.max("ms").alias("max"), F.sum(F.col("ms") * F.col("c")).alias("total"))
    # One row.
    joined = ranked.join(F.broadcast(total), "_all")
    at = lambda p: F.max(F.when((F.col("before") < nearest_rank(p, F.col("n"))) & (nearest_rank(p, F.col("n")) <= F.col("before") + F.col("c")), F.col("ms")))
    return joined.groupBy("n", "min", "max", "total").agg(at(50).alias("p50"), at(95).alias("p95")).withColumn("mean", F.col("total") / F.col("n"))


def average_ranks(df: DataFrame, by: list[str], column: str, name: str) -> DataFrame:
    """Add ``name``: the rank of ``column`` from 1, ties sharing the mean of their ranks.

    Ranks are running sums over counts of distinct values, so no task sorts everything.
    """
    counts = df.groupBy(*by, column).agg(F.count(F.lit(1)).alias("_c"))
    ranked = sum_before(counts, by, [column], "_c", "_before").select(*[F.col(c).alias(f"_k_{c}") for c in [*by, column]], (F.col("_before") + (F.col("_c") + 1) / 2).alias(name))
    on = F.lit(True)
    for c in [*by, column]:
        on = on & df[c].eqNullSafe(F.col(f"_k_{c}"))
    return df.join(ranked, on).drop(*[f"_k_{c}" for c in [*by, column]])


def spearman(df: DataFrame, by: list[str], a: str, b: str) -> DataFrame:
    """rho: correlation of average ranks; null under 3 rows or without variance."""
    pairs = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(*by, F.col(a).cast("double").alias("_a"), F.col(b).cast("double").alias("_b"))
    ranked = average_ranks(average_ranks(pairs, by, "_a", "_ra"), by, "_b", "_rb")
    varies = (F.count(F.lit(1)) >= 3) & (F.max("_ra") > F.min("_ra")) & (F.max("_rb") > F.min("_rb"))
    return ranked.groupBy(*by).agg(F.when(varies, F.try_divide(F.covar_pop("_ra", "_rb"), F.stddev_pop("_ra") * F.stddev_pop("_rb"))).alias("rho"), F.count(F.lit(1)).alias("n"))


def _score_counts(df: DataFrame, by: list[str], score: str, gold: str) -> DataFrame:
    used = df.where(F.col(gold).isNotNull() & F.col(score).isNotNull())
    return used.groupBy(*by, F.col(score).alias("s")).agg(count_if(F.col(gold)).alias("pos"), count_if(~F.col(gold)).alias("neg"))


def roc_auc(df: DataFrame, by: list[str], score: str = "score", gold: str = "gold_bool") -> DataFrame:
    """P(positive scores higher) + half of P(tie); null if a class is empty."""
    counts = sum_before(_score_counts(df, by, score, gold), by, ["s"], "neg", "below")
    wins = F.sum(F.col("pos") * (F.col("below") + F.col("neg") / 2))
    return counts.groupBy(*by).agg(F.when((F.sum("pos") > 0) & (F.sum("neg") > 0), wins / (F.sum("pos") * F.sum("neg"))).alias("auc"), F.sum("pos").alias("positives"), F.sum("neg").alias("negatives"))


def log_factorial(n: Column) -> Column:
    """ln n! by Stirling's series ten steps up, and back again."""
    z = n + F.lit(11.0)
    series = (z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + 1 / (12 * z) - 1 / (360 * z * z * z) + 1 / (1260 * z * z * z * z * z)
    for k in range(1, 11):
        series = series - F.log(n + F.lit(float(k)))
    return series


def mcnemar(df: DataFrame, by: list[str], left: str, right: str) -> DataFrame:
    """Exact two-sided test on two columns of right/wrong: b (only left right), c (only right right), p.

    The binomial tail is summed from its largest term down; terms further than 12 standard
    deviations are under 1e-30 of it, so some 6 root n of them are there however many pairs.
    """
    counts = df.groupBy(*by).agg(count_if(F.col(left) & ~F.col(right)).alias("b"), count_if(~F.col(left) & F.col(right)).alias("c"))
    n, k = F.col("b") + F.col("c"), F.least("b", "c")
    last = F.greatest(F.lit(1).cast("long"), k - F.ceil(6 * F.sqrt(n)).cast("long") - 60)
    top = log_factorial(n) - log_factorial(k) - log_factorial(n - k) - n * math.log(2)
    start = F.struct(top.alias("t"), F.exp(top).alias("s"))
    term = lambda acc, i: acc["t"] + F.log(i / (n - i + 1))
    step = lambda acc, i: F.struct(term(acc, i).alias("t"), (acc["s"] + F.exp(term(acc, i))).alias("s"))
    places = F.when(k >= 1, F.sequence(k, last, F.lit(-1).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    tail = F.aggregate(places, start, step)["s"]
    return counts.withColumn("p", F.when(n == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), 2 * tail)))


def wilson(hits: Column, n: Column, z: float = WILSON_Z) -> tuple[Column, Column]:
    """Interval of a proportion; (0, 1) if there are no trials."""
    p, z2 = hits / n, z * z
    middle, half = p + z2 / (2 * n), z * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n))
    low, high = (middle - half) / (1 + z2 / n), (middle + half) / (1 + z2 / n)
    return F.when(n == 0, 0.0).otherwise(F.greatest(F.lit(0.0), low)), F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), high))


def wilson_interval(df: DataFrame, hits: str = "hits", n: str = "n") -> DataFrame:
    low, high = wilson(F.col(hits), F.col(n))
    return df.withColumn("low", low).withColumn("high", high)


def threshold_table(df: DataFrame, by: list[str], score: str = "score", gold: str = "gold_bool") -> DataFrame:
    """threshold, inverted, accuracy of every candidate: distinct scores with 0 and 1, both polarities."""
    counts = _score_counts(df, by, score, gold)
    keys = counts.select(*by).distinct() if by else counts.limit(1).select()
    ends = keys.withColumn("s", F.explode(F.array(F.lit(0.0), F.lit(1.0)))).withColumn("pos", F.lit(0).cast("long")).withColumn("neg", F.lit(0).cast("long"))
    all_counts = counts.unionByName(ends).groupBy(*by, "s").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    below = sums_before(all_counts, by, ["s"], {"pos_below": "pos", "neg_below": "neg"})
    totals = counts.groupBy(*[F.col(c).alias(f"_{c}") for c in by]).agg(F.sum("pos").alias("all_pos"), F.sum("neg").alias("all_neg"))
    on = F.lit(True)
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(f"_{c}"))
    # One row for each value of ``by``.
    table = below.join(F.broadcast(totals), on)
    hits = F.col("all_pos") - F.col("pos_below") + F.col("neg_below")
    n = F.col("all_pos") + F.col("all_neg")
    ways = F.array(F.struct(F.lit(False).alias("inverted"), hits.alias("hits")), F.struct(F.lit(True).alias("inverted"), (n - hits).alias("hits")))
    return table.withColumn("w", F.explode(ways)).select(*by, F.col("s").alias("threshold"), "w.inverted", "w.hits", n.alias("n"), (F.col("w.hits") / n).alias("accuracy"))


def best_threshold(df: DataFrame, by: list[str], score: str = "score", gold: str = "gold_bool") -> DataFrame:
    """The candidate of largest accuracy.  Ties: the first in (threshold, not inverted) order, unless the
    accuracy rounded to 4 digits is below it; then the last (candidates are compared with the rounded best)."""
    table = threshold_table(df, by, score, gold)
    top = table.groupBy(*[F.col(c).alias(f"_{c}") for c in by]).agg(F.max("accuracy").alias("_top"))
    on = F.lit(True)
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(f"_{c}"))
    tied = table.join(F.broadcast(top), on).where("accuracy = _top")
    order = F.struct("threshold", "inverted")
    first, last = F.min(order), F.max(order)
    picked = F.when(F.round(F.max("_top"), 4) < F.max("_top"), last).otherwise(first)
    return tied.groupBy(*by).agg(F.max("accuracy").alias("accuracy"), picked.alias("_p"), F.max("n").alias("n")).select(*by, "accuracy", "_p.threshold", "_p.inverted", "n")


def majority(df: DataFrame, by: list[str], gold: str = "gold_bool") -> DataFrame:
    """The more frequent class (true on a tie) and its share."""
    p = share(F.col(gold))
    return df.where(F.col(gold).isNotNull()).groupBy(*by).agg((p >= 0.5).alias("majority"), F.greatest(p, 1 - p).alias("baseline"), F.count(F.lit(1)).alias("n"))


def binary_diagnostics(df: DataFrame, by: list[str]) -> DataFrame:
    """AUC, in-sample threshold, majority share and accuracy at 1/2 of binary scores, with its Wilson interval."""
    used = df.where("gold_bool IS NOT NULL AND score IS NOT NULL")
    base = used.groupBy(*by).agg(count_if((F.col("score") >= 0.5) == F.col("gold_bool")).alias("hits"), F.count(F.lit(1)).alias("n"), F.avg("score").alias("mean_score"))
    best = best_threshold(used, by).select(*by, F.col("accuracy").alias("best_accuracy"), "threshold", "inverted")
    joined = wilson_interval(base).join(roc_auc(used, by).select(*by, "auc"), by).join(best, by).join(majority(used, by).select(*by, "baseline"), by)
    return joined.withColumn("accuracy", F.col("hits") / F.col("n"))


def ranking_signal(df: DataFrame, by: list[str], points: str = "points", value: str = "value", p_high: str = "p_high", p_low: str = "p_low") -> DataFrame:
    """Spearman's rho of gold points with an ordinal answer's expected level, P(high) and P(low), and the rows it stands on."""
    base = None
    for name, column in (("rho_value", value), ("rho_high", p_high), ("rho_low", p_low)):
        one = spearman(df, by, points, column).select(*by, F.col("rho").alias(name), *([F.col("n")] if base is None else []))
        base = one if base is None else base.join(one, by)
    return base


def estimated_ms(tokens: Column, slope: float, intercept: float) -> Column:
    """Time that a card of so many tokens takes by a fitted line."""
    return F.lit(intercept) + F.lit(slope) * tokens


def ols_line(df: DataFrame, x: str, y: str) -> DataFrame:
    """slope and intercept of y on x."""
    return df.agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.count(F.lit(1)).alias("n"))


