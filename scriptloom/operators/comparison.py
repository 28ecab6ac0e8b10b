"""Wordings, ordinal cuts, resampling and run comparison as DataFrame plans."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.workspace import write_table
from .holdout import threshold_halves
from .metrics import best_threshold, count_if, mcnemar, roc_auc, share, wilson
from .ranking import sums_before
from .rubric import BAND_ORDER
from .splits import same

INVERSION_TOLERANCE = 0.15
PLACES = 3
TIE_TOLERANCE = 0.03
_PRIME = 2147483647
_WHEEL = 1_000_003


# -- Splits ---------------------------------------------------------------------


def hash_splits(df: DataFrame, row_id: str, repeats: int, fraction: float = 0.5) -> DataFrame:
    """Each row once for each split, with ``split`` and ``is_train`` by a hash of row and split (squares modulo a prime).

    Nothing is collected or sorted, so it holds at any size; classes keep their shares up to chance.
    """
    spread = df.withColumn("split", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(repeats - 1).cast("long"))))
    # Ids that agree in one remainder differ in the other.
    some, rest = F.pmod(F.col(row_id), F.lit(_WHEEL)), F.pmod(F.floor(F.col(row_id) / F.lit(_WHEEL)), F.lit(_WHEEL))
    k = (some * 7919 + rest * 15485863 + F.col("split") * 104729) % _PRIME
    k = (k * k + F.col("split")) % _PRIME * 48271 % _PRIME
    return spread.withColumn("is_train", k % 1000 < int(fraction * 1000))


def seeded_splits(spark: SparkSession, groups: list[list], repeats: int, seed: int = 42, fraction: float = 0.5, least: int = 2) -> DataFrame:
    """split, row_id, is_train: stratified splits of one seeded generator, for corpora whose ids fit the driver.

    Each group's ids (in a fixed order) are shuffled; the first half-even rounded share, ``least`` at least, is for training.
    """
    rng = random.Random(seed)
    rows = []
    for split in range(repeats):
        for ids in groups:
            order = list(ids)
            rng.shuffle(order)
            cut = max(least, round(len(order) * fraction))
            rows += [(split, x, i < cut) for i, x in enumerate(order)]
    return spark.createDataFrame(rows, "split long, row_id long, is_train boolean")


def spread(df: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """n, mean, p05, p95 of a value over splits: observed values at positions int(.05 n) and min(n - 1, int(.95 n)).

    The number of splits bounds what is collected for each group.
    """
    ordered = F.array_sort(F.collect_list(value))
    grouped = df.groupBy(*(by or [])).agg(ordered.alias("_v"), F.avg(value).alias("mean"), F.count(value).alias("n"))
    at = lambda p: F.get(F.col("_v"), F.least(F.col("n") - 1, F.floor(F.lit(p) * F.col("n"))).cast("int"))
    return grouped.where("n > 0").select(*(by or []), "n", "mean", at(0.05).alias("p05"), at(0.95).alias("p95"))


def verdict(p05: Column, p95: Column) -> Column:
    return F.when(p05 > 0, "win").when(p95 < 0, "loss").otherwise("tie")


def holdout_summary(df: DataFrame, row_id: str, repeats: int = 500, by: list[str] | None = None, least: int = 4) -> DataFrame:
    """Of thresholds fitted on stratified halves of the rows (``gold_bool``, ``score``), over ``repeats`` splits: n (splits),
    mean, p05 and p95 of the accuracy on the other half; median (the upper of two), least and largest threshold; accuracy
    at 1/2 and in hindsight (fitted on all rows), the gap of the latter to the mean and the mean's gain over 1/2.

    See ``holdout.threshold_halves`` for which rows and values of ``by`` are left out.  A number a split is collected
    for each value of ``by``.
    """
    by = by or []
    used = df.where("gold_bool IS NOT NULL AND score IS NOT NULL AND NOT isnan(score)")
    tested = write_table(threshold_halves(used, by, row_id, repeats, least=least), "holdout")
    fitted = F.array_sort(F.collect_list("threshold"))
    upper = F.get(fitted, F.floor(F.size(fitted) / 2).cast("int"))
    cuts = tested.groupBy(*by).agg(upper.alias("median_threshold"), F.min("threshold").alias("least_threshold"), F.max("threshold").alias("largest_threshold"))
    at_half = used.groupBy(*by).agg(share((F.col("score") >= 0.5) == F.col("gold_bool")).alias("accuracy_at_half"))
    hindsight = best_threshold(used, by).select(*by, F.col("accuracy").alias("hindsight"))
    out = spread(tested, "test_accuracy", by)
    for part in (cuts, at_half, hindsight):
        other = part.withColumnsRenamed({c: f"_{c}" for c in by})
        out = out.join(other, same(by, [f"_{c}" for c in by])).drop(*[f"_{c}" for c in by])  # one row for each value of ``by``
    return out.withColumn("gap", F.col("hindsight") - F.col("mean")).withColumn("gain", F.col("mean") - F.col("accuracy_at_half"))


def majority_holdout(split_rows: DataFrame) -> DataFrame:
    """split, test accuracy of the class that is more frequent in training (true on a tie)."""
    gold = F.col("gold_bool")
    call = split_rows.where("is_train").groupBy("split").agg((2 * count_if(gold) >= F.count(gold)).alias("call"))
    tested = split_rows.where("NOT is_train AND gold_bool IS NOT NULL").join(call, "split")
    return tested.groupBy("split").agg(share(gold == F.col("call")).alias("test_accuracy"))


# -- Wordings -------------------------------------------------------------------


def average(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v) / F.size(x)


def median(x: Column) -> Column:
    s, n = F.array_sort(x), F.size(x)
    return (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2


def trimmed(x: Column, k: int = 1) -> Column:
    """Mean without the ``k`` least and largest, if more than 2 k are there."""
    n = F.size(x)
    return F.when(n > 2 * k, average(F.slice(F.array_sort(x), F.lit(k + 1), F.greatest(n - 2 * k, F.lit(1))))).otherwise(average(x))


AGGREGATORS = {"mean": average, "median": median, "trimmed": trimmed}


def aggregate_scores(answers: DataFrame, wordings: list[str], how: str = "mean") -> DataFrame:
    """script, score: over all ``wordings`` of a question (column ``question``); scripts that miss one are dropped."""
    used = answers.where(F.col("question").isin(wordings)).groupBy("script").agg(F.collect_list("value_num").alias("x"), F.countDistinct("question").alias("k"))
    return used.where(F.col("k") == len(wordings)).select("script", AGGREGATORS[how](F.col("x")).alias("score"))


def ensemble(rows: DataFrame, scores: str, wordings: int) -> DataFrame:
    """kind, name, auc, accuracy at 1/2, mean: each wording alone and each aggregator over the array ``scores``."""
    complete = rows.where((F.size(scores) == wordings) & ~F.exists(scores, lambda v: v.isNull()) & F.col("gold_bool").isNotNull())
    named = [F.struct(F.lit("single").alias("kind"), F.lit(f"w{i}").alias("name"), F.get(F.col(scores), i).alias("score")) for i in range(wordings)]
    named += [F.struct(F.lit("aggregated").alias("kind"), F.lit(n).alias("name"), f(F.col(scores)).alias("score")) for n, f in AGGREGATORS.items()]
    long = complete.select("gold_bool", F.explode(F.array(*named)).alias("x")).select("gold_bool", "x.*").withColumn("score", F.round("score", 9))
    base = long.groupBy("kind", "name").agg(share((F.col("score") >= 0.5) == F.col("gold_bool")).alias("accuracy_at_half"), F.avg("score").alias("mean_score"))
    return roc_auc(long, ["kind", "name"]).select("kind", "name", "auc").join(base, ["kind", "name"])


def ensemble_spread(table: DataFrame) -> DataFrame:
    """Least, largest and mean AUC of single wordings, the mean's AUC, and whether aggregation helps (by 0.03 over the mean single)."""
    single = lambda c: F.when(F.col("kind") == "single", F.col(c))
    one = table.agg(
        F.min(single("auc")).alias("auc_min"), F.max(single("auc")).alias("auc_max"), F.avg(single("auc")).alias("auc_mean"),
        F.max(F.when(F.col("name") == "mean", F.col("auc"))).alias("auc_of_mean"),
    )
    gain = F.col("auc_of_mean") - F.col("auc_mean")
    verdict_ = F.when(gain > TIE_TOLERANCE, "helps").when(gain < -TIE_TOLERANCE, "hurts").otherwise("neutral")
    return one.withColumn("spread", F.col("auc_max") - F.col("auc_min")).withColumn("verdict", verdict_)


def variant_probe(long: DataFrame, variants: tuple[str, str, str] = ("v1", "v2", "v3")) -> DataFrame:
    """question, AUC of each variant, the shift between two wordings, and whether the negated third inverts."""
    auc = roc_auc(long, ["question", "variant"]).groupBy("question").pivot("variant", list(variants)).agg(F.first("auc"))
    a, b, c = (F.col(v) for v in variants)
    return auc.select(
        "question", *[F.col(v).alias(f"auc_{v}") for v in variants], F.abs(a - b).alias("paraphrase_shift"), (1 - a).alias("negation_predicted"),
        (F.abs(c - (1 - a)) <= INVERSION_TOLERANCE).alias("inverted"),
    )


def variant_summary(probe: DataFrame) -> DataFrame:
    return probe.agg(
        F.count(F.lit(1)).alias("questions"), F.avg("paraphrase_shift").alias("mean_shift"), F.max("paraphrase_shift").alias("max_shift"),
        count_if(F.col("inverted")).alias("inverted"), count_if(~F.col("inverted")).alias("not_inverted"),
    )


# -- Ordinal answers ------------------------------------------------------------


def expected_level(probabilities: Column) -> Column:
    """Sum of p x position over an array of doubles, rounded to ``PLACES``."""
    terms = F.transform(probabilities, lambda p, i: p * i)
    return F.round(F.aggregate(terms, F.lit(0.0), lambda a, v: a + v), PLACES)


def cut_level(value: Column, low: Column, high: Column) -> Column:
    return F.when(value < low, 0).when(value < high, 1).otherwise(2).cast("long")


def fit_cuts(df: DataFrame, by: list[str], value: str = "value", level: str = "level") -> DataFrame:
    """low, high, hits: the pair of cuts (low <= high, values of the table) with most rows on their own level.

    The first best pair wins; with fewer than 3 distinct values the cuts are 0 and 0.
    Hits are a term of the low cut and one of the high cut: the best low cut up to each value is a running maximum.
    """
    counts = df.groupBy(*by, F.col(value).alias("v")).agg(*[count_if(F.col(level) == k).alias(f"c{k}") for k in range(3)])
    of_low = F.struct((F.col("b0") - F.col("b1")).alias("hits"), (-F.col("v")).alias("less"))
    counts = sums_before(counts, by, ["v"], {f"b{k}": f"c{k}" for k in range(3)}, {"low": of_low})
    totals = df.groupBy(*[F.col(c).alias(f"_{c}") for c in by]).agg(count_if(F.col(level) == 2).alias("all2"), F.countDistinct(value).alias("grid"), F.count(F.lit(1)).alias("n"))
    on = F.lit(True)
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(f"_{c}"))
    # One row for each value of ``by``.
    table = counts.join(F.broadcast(totals), on).drop(*[f"_{c}" for c in by])
    hits = F.col("low.hits") + F.col("b1") + F.col("all2") - F.col("b2")
    best = table.groupBy(*by, "grid", "n").agg(F.max(F.struct(hits.alias("hits"), F.col("low.less").alias("less_low"), (-F.col("v")).alias("less_high"))).alias("r"))
    few = F.col("grid") < 3
    zero = F.lit(0.0)
    return best.select(*by, F.when(few, zero).otherwise(-F.col("r.less_low")).alias("low"), F.when(few, zero).otherwise(-F.col("r.less_high")).alias("high"), F.when(~few, F.col("r.hits")).alias("hits"), "n")


def error_structure(df: DataFrame, by: list[str], predicted: str = "predicted", level: str = "level") -> DataFrame:
    """Shares of rows that are exact, one band off, two bands off, within one band."""
    d = F.abs(F.col(predicted) - F.col(level))
    return df.groupBy(*by).agg(share(d == 0).alias("exact"), share(d == 1).alias("one_band"), share(d == 2).alias("two_bands"), share(d <= 1).alias("within_one"), F.count(F.lit(1)).alias("n"))


def ordinal_scores(df: DataFrame, by: list[str], value: str = "value", level: str = "level") -> DataFrame:
    """AUC of low against high, accuracy of cuts fitted and scored on the same rows, and their error structure."""
    ends = df.where(F.col(level) != 1).withColumn("gold_bool", F.col(level) == 2).withColumn("score", F.col(value))
    cuts = fit_cuts(df, by, value, level)
    placed = df.join(cuts.select(*by, "low", "high"), by).withColumn("predicted", cut_level(F.col(value), F.col("low"), F.col("high")))
    return error_structure(placed, by, "predicted", level).join(roc_auc(ends, by).select(*by, "auc"), by).join(cuts.select(*by, "low", "high"), by)


def cuts_holdout(split_rows: DataFrame) -> DataFrame:
    """split and error structure of cuts fitted on training rows, scored on the others."""
    cuts = fit_cuts(split_rows.where("is_train"), ["split"])
    tested = split_rows.where("NOT is_train").join(cuts.select("split", "low", "high"), "split")
    return error_structure(tested.withColumn("predicted", cut_level(F.col("value"), F.col("low"), F.col("high"))), ["split"])


def level_of(band: Column) -> Column:
    return (F.array_position(F.array(*[F.lit(b) for b in BAND_ORDER]), band) - 1).cast("long")


def majority_vote(labels: Column) -> Column:
    """The most frequent of an array of labels, ties to the first by name."""
    distinct = F.array_sort(F.array_distinct(labels))
    counted = F.transform(distinct, lambda x: F.struct((-F.size(F.filter(labels, lambda y: y == x))).alias("n"), x.alias("label")))
    return F.array_min(counted)["label"]


def strategy_score(df: DataFrame, predicted: str, gold: str) -> DataFrame:
    """n, hits, distinct predictions, accuracy with its Wilson interval, majority share of a nominal question."""
    used = df.where(F.col(gold).isNotNull())
    counts = used.groupBy(gold).agg(F.count(F.lit(1)).alias("c")).agg(F.max("c").alias("m"))
    one = used.agg(F.count(F.lit(1)).alias("n"), count_if(F.col(predicted) == F.col(gold)).alias("hits"), F.countDistinct(predicted).alias("distinct_predictions")).crossJoin(F.broadcast(counts))
    low, high = wilson(F.col("hits"), F.col("n"))
    return one.select("n", "hits", "distinct_predictions", F.try_divide("hits", "n").alias("accuracy"), low.alias("low"), high.alias("high"), F.try_divide("m", "n").alias("majority"))


def compare_runs(left: DataFrame, right: DataFrame, gold: DataFrame) -> DataFrame:
    """question, n, accuracies, AUCs and means of two runs (origin, question, score) on what both and gold have, with McNemar (right against left)."""
    joined = left.withColumnRenamed("score", "l").join(right.withColumnRenamed("score", "r"), ["origin", "question"]).join(gold.where("gold_bool IS NOT NULL"), ["origin", "question"])
    ok = lambda c: (F.col(c) >= 0.5) == F.col("gold_bool")
    base = joined.groupBy("question").agg(F.count(F.lit(1)).alias("n"), share(ok("l")).alias("left_accuracy"), share(ok("r")).alias("right_accuracy"), F.avg("l").alias("left_mean"), F.avg("r").alias("right_mean"))
    test = mcnemar(joined.withColumn("lo", ok("l")).withColumn("ro", ok("r")), ["question"], "ro", "lo").select("question", F.col("b").alias("right_only"), F.col("c").alias("left_only"), "p")
    aucs = [roc_auc(joined, ["question"], c).select("question", F.col("auc").alias(f"{n}_auc")) for n, c in (("left", "l"), ("right", "r"))]
    return base.join(test, "question").join(aucs[0], "question").join(aucs[1], "question")


