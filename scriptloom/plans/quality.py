"""Queries on classifier quality over the scored-outcomes view."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import metrics as M
from ..registry import query
from ..sources.tables import table
from .scored import SCORED_SQL, rounded, scored_outcomes

WITH = f"WITH {SCORED_SQL}"
QUESTIONS = ("en", "fr", "de", "es")


@query("accuracy_by_question", f"""{WITH}
SELECT question, count(*) FILTER (WHERE gradable AND agree) AS hits, count(*) FILTER (WHERE gradable) AS total,
       round(coalesce(avg(CASE WHEN gradable THEN CAST(agree AS INT) END), 0), 6) AS ratio FROM o GROUP BY question""")
def accuracy_by_question(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(M.accuracy(scored_outcomes(spark, sf_dir), ["question"]))


@query("majority_lift", f"""{WITH},
g AS (SELECT question, gold, count(*) AS n, count(*) FILTER (WHERE agree) AS correct, sum(confidence) AS conf FROM o WHERE gradable GROUP BY question, gold),
u AS (SELECT question, count(*) FILTER (WHERE NOT gradable) AS ungraded, count(DISTINCT CASE WHEN gradable THEN predicted END) AS dp FROM o GROUP BY question)
SELECT g.question AS question, CAST(sum(n) AS BIGINT) AS n, CAST(max(ungraded) AS BIGINT) AS ungraded, round(max(n) / sum(n), 6) AS majority,
       CAST(sum(correct) AS BIGINT) AS correct, round(sum(correct) / sum(n), 6) AS accuracy, round(sum(conf) / sum(n), 6) AS mean_confidence,
       CAST(max(dp) AS BIGINT) AS distinct_predictions, round(sum(correct) / sum(n) - max(n) / sum(n), 6) AS lift,
       round(sum(conf) / sum(n) - sum(correct) / sum(n), 6) AS overconfidence
FROM g JOIN u ON g.question = u.question GROUP BY g.question""")
def majority_lift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(M.per_question(scored_outcomes(spark, sf_dir)))


@query("confusion_matrix", f"""{WITH}
SELECT l.gold AS gold, count(*) FILTER (WHERE o.predicted = 'true') AS pred_true, count(*) FILTER (WHERE o.predicted = 'false') AS pred_false
FROM (VALUES ('true'), ('false')) l(gold) LEFT JOIN o ON o.gold = l.gold AND o.gradable GROUP BY l.gold""")
def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.confusion(scored_outcomes(spark, sf_dir), ["true", "false"])


_BINS = "CAST(floor(least(greatest(confidence, 0), 0.999999) * 5) AS BIGINT)"


@query("ece_bins", f"""{WITH}
SELECT {_BINS} AS bin, count(*) AS n, round(avg(confidence), 6) AS mean_confidence, round(avg(CAST(agree AS INT)), 6) AS accuracy
FROM o WHERE gradable GROUP BY 1""")
def ece_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(M.reliability(scored_outcomes(spark, sf_dir)))


@query("calibration_error", f"""{WITH},
b AS (SELECT {_BINS} AS bin, count(*) AS n, avg(confidence) AS c, avg(CAST(agree AS INT)) AS a FROM o WHERE gradable GROUP BY 1)
SELECT round(sum(n * abs(c - a)) / sum(n), 6) AS ece, CAST(sum(n) AS BIGINT) AS n FROM b""")
def calibration_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(M.calibration_error(scored_outcomes(spark, sf_dir)))


@query("brier", f"""{WITH}
SELECT question, round(avg(power(confidence - CAST(agree AS INT), 2)), 6) AS brier, count(*) AS n FROM o WHERE gradable GROUP BY question""")
def brier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(M.brier(scored_outcomes(spark, sf_dir), ["question"]))


@query("coverage_curve", f"""{WITH}
SELECT CAST(t.cut AS DOUBLE) AS cut, count(*) FILTER (WHERE confidence >= t.cut) AS kept, round(avg(CAST(confidence >= t.cut AS INT)), 6) AS coverage,
       round(avg(CASE WHEN confidence >= t.cut THEN CAST(agree AS INT) END), 6) AS accuracy, count(*) FILTER (WHERE confidence >= t.cut AND NOT agree) AS errors
FROM o, (SELECT unnest([0.5, 0.6, 0.7, 0.8, 0.85, 0.9, 0.95]::DOUBLE[]) AS cut) t WHERE gradable GROUP BY t.cut""")
def coverage_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(M.coverage_curve(scored_outcomes(spark, sf_dir)))


@query("script_coverage", f"""{WITH},
s AS (SELECT t.cut AS cut, row_id // 3 AS script, bool_and(gradable AND confidence >= t.cut) AS ok, count(DISTINCT CASE WHEN gradable AND confidence >= t.cut THEN question END) AS q,
             bool_and(agree) AS right_ FROM o, (SELECT unnest([0.5, 0.6, 0.7, 0.8, 0.85, 0.9]::DOUBLE[]) AS cut) t WHERE question IN ('en') GROUP BY 1, 2)
SELECT cut, count(*) AS scripts, count(*) FILTER (WHERE ok AND q = 1) AS kept, round(avg(CASE WHEN ok AND q = 1 THEN CAST(right_ AS INT) END), 6) AS accuracy FROM s GROUP BY cut""")
def script_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three neighbouring documents are a script here."""
    return rounded(M.script_coverage(scored_outcomes(spark, sf_dir).withColumn("script", F.floor(F.col("row_id") / 3)), ["en"]))


@query("ungraded_counts", f"""{WITH}
SELECT question, count(*) FILTER (WHERE gradable) AS graded, count(*) FILTER (WHERE NOT gradable) AS ungraded FROM o GROUP BY question""")
def ungraded_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = F.col("gradable")
    return scored_outcomes(spark, sf_dir).groupBy("question").agg(M.count_if(g).alias("graded"), M.count_if(~g).alias("ungraded"))




@query("auc_by_question", f"""{WITH},
r AS (SELECT question, gold_bool, rank() OVER (PARTITION BY question ORDER BY score) + (count(*) OVER (PARTITION BY question, score) - 1) / 2.0 AS r FROM o WHERE gold_bool IS NOT NULL),
s AS (SELECT question, sum(CASE WHEN gold_bool THEN r END) AS rs, count(*) FILTER (WHERE gold_bool) AS p, count(*) FILTER (WHERE NOT gold_bool) AS n FROM r GROUP BY question)
SELECT question, round(CASE WHEN p > 0 AND n > 0 THEN (rs - p * (p + 1) / 2.0) / (p * n) END, 6) AS auc, p AS positives, n AS negatives FROM s""")
def auc_by_question(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(M.roc_auc(scored_outcomes(spark, sf_dir), ["question"]))


@query("auc_pairs", f"""{WITH}
SELECT round(avg(CASE WHEN p.score > n.score THEN 1.0 WHEN p.score = n.score THEN 0.5 ELSE 0.0 END), 6) AS auc,
       count(DISTINCT p.row_id) AS positives, count(DISTINCT n.row_id) AS negatives
FROM o p, o n WHERE p.gold_bool AND NOT n.gold_bool""")
def auc_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows as one group; the SQL counts pairs one by one."""
    found = M.roc_auc(scored_outcomes(spark, sf_dir).withColumn("g", F.lit(1)), ["g"])
    return rounded(found.drop("g"))


_RANK = "rank() OVER (PARTITION BY question ORDER BY {c}) + (count(*) OVER (PARTITION BY question, {c}) - 1) / 2.0"


@query("spearman_rank", f"""{WITH},
x AS (SELECT o.question, o.score AS a, CAST(d.n_chars AS DOUBLE) AS b FROM o JOIN documents d ON d.doc_id = o.row_id),
r AS (SELECT question, {_RANK.format(c='a')} AS ra, {_RANK.format(c='b')} AS rb FROM x)
SELECT question, round(corr(ra, rb), 6) AS rho, count(*) AS n FROM r GROUP BY question""")
def spearman_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("row_id"), "n_chars")
    return rounded(M.spearman(scored_outcomes(spark, sf_dir).join(sizes, "row_id"), ["question"], "score", "n_chars"))


@query("mcnemar_exact", f"""{WITH},
c AS (SELECT question, count(*) FILTER (WHERE agree AND score < 0.3) AS b, count(*) FILTER (WHERE NOT agree AND score >= 0.3 AND score < 0.4) AS c FROM o WHERE gradable GROUP BY question),
k AS (SELECT question, b, c, b + c AS n, least(b, c) AS m FROM c),
t AS (SELECT question, sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) - n * ln(2.0::DOUBLE))) AS tail FROM k, LATERAL (SELECT unnest(range(0, m + 1)) AS i) GROUP BY question)
SELECT k.question AS question, b, c, round(CASE WHEN n = 0 THEN 1.0 ELSE least(1.0, 2 * tail) END, 5) AS p FROM k JOIN t ON k.question = t.question""")
def mcnemar_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    used = M.gradable(scored_outcomes(spark, sf_dir))
    left = F.col("agree") & (F.col("score") < 0.3)
    right = ~F.col("agree") & (F.col("score") >= 0.3) & (F.col("score") < 0.4)
    return rounded(M.mcnemar(used.withColumn("l", left).withColumn("r", right), ["question"], "l", "r"), 5)


@query("wilson", f"""{WITH},
a AS (SELECT question, count(*) FILTER (WHERE agree) AS hits, count(*) AS n FROM o WHERE gradable GROUP BY question)
SELECT question, hits, n,
  round(greatest(0, (hits / n + 3.8416 / (2 * n) - 1.96 * sqrt(hits / n * (1 - hits / n) / n + 3.8416 / (4.0 * n * n))) / (1 + 3.8416 / n)), 6) AS low,
  round(least(1, (hits / n + 3.8416 / (2 * n) + 1.96 * sqrt(hits / n * (1 - hits / n) / n + 3.8416 / (4.0 * n * n))) / (1 + 3.8416 / n)), 6) AS high FROM a""")
def wilson(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = M.gradable(scored_outcomes(spark, sf_dir)).groupBy("question").agg(M.count_if(F.col("agree")).alias("hits"), F.count(F.lit(1)).alias("n"))
    return rounded(M.wilson_interval(a))


THRESHOLD_SQL = """
u AS (SELECT question, score, gold_bool FROM o WHERE gold_bool IS NOT NULL),
cand AS (SELECT question, score AS threshold FROM u UNION SELECT question, 0.0::DOUBLE FROM u UNION SELECT question, 1.0::DOUBLE FROM u),
acc AS (SELECT c.question, c.threshold, i.inverted, count(*) FILTER (WHERE ((u.score >= c.threshold) <> i.inverted) = u.gold_bool) AS hits, count(*) AS n
        FROM cand c JOIN u ON u.question = c.question, (VALUES (FALSE), (TRUE)) i(inverted) GROUP BY 1, 2, 3),
ranked AS (SELECT *, hits / n AS a, max(hits / n) OVER (PARTITION BY question) AS top,
             row_number() OVER (PARTITION BY question, hits ORDER BY threshold, inverted) AS rf, row_number() OVER (PARTITION BY question, hits ORDER BY threshold DESC, inverted DESC) AS rl FROM acc),
best AS (SELECT question, a AS accuracy, threshold, inverted, n FROM ranked WHERE a = top AND CASE WHEN round(top, 4) < top THEN rl = 1 ELSE rf = 1 END)
"""


@query("best_threshold", f"{WITH}, {THRESHOLD_SQL} SELECT question, round(accuracy, 6) AS accuracy, threshold, inverted, n FROM best")
def best_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(M.best_threshold(scored_outcomes(spark, sf_dir), ["question"]))


@query("binary_diagnostics", f"""{WITH}, {THRESHOLD_SQL},
b AS (SELECT question, count(*) FILTER (WHERE (score >= 0.5) = gold_bool) AS hits, count(*) AS n, avg(score) AS ms, avg(CAST(gold_bool AS INT)) AS p FROM o WHERE gold_bool IS NOT NULL GROUP BY question),
r AS (SELECT question, gold_bool, {_RANK.format(c='score')} AS r FROM o WHERE gold_bool IS NOT NULL),
s AS (SELECT question, sum(CASE WHEN gold_bool THEN r END) AS rs, count(*) FILTER (WHERE gold_bool) AS p, count(*) FILTER (WHERE NOT gold_bool) AS n FROM r GROUP BY question)
SELECT b.question AS question, b.hits AS hits, b.n AS n, round(b.ms, 6) AS mean_score, round(b.hits / b.n, 6) AS accuracy,
  round(greatest(0, (b.hits / b.n + 3.8416 / (2 * b.n) - 1.96 * sqrt(b.hits / b.n * (1 - b.hits / b.n) / b.n + 3.8416 / (4.0 * b.n * b.n))) / (1 + 3.8416 / b.n)), 6) AS low,
  round(least(1, (b.hits / b.n + 3.8416 / (2 * b.n) + 1.96 * sqrt(b.hits / b.n * (1 - b.hits / b.n) / b.n + 3.8416 / (4.0 * b.n * b.n))) / (1 + 3.8416 / b.n)), 6) AS high,
  round(CASE WHEN s.p > 0 AND s.n > 0 THEN (rs - s.p * (s.p + 1) / 2.0) / (s.p * s.n) END, 6) AS auc, round(best.accuracy, 6) AS best_accuracy, best.threshold AS threshold, best.inverted AS inverted, round(greatest(b.p, 1 - b.p), 6) AS baseline
FROM b JOIN s ON s.question = b.question JOIN best ON best.question = b.question""")
def binary_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(M.binary_diagnostics(scored_outcomes(spark, sf_dir), ["question"]))


@query("latency_summary", """
WITH v AS (SELECT CAST(value AS DOUBLE) AS ms FROM events WHERE value > 0),
r AS (SELECT ms, row_number() OVER (ORDER BY ms) AS r, count(*) OVER () AS n FROM v)
SELECT max(n) AS n, min(ms) AS min, max(ms) AS max, round(sum(ms), 4) AS total, round(avg(ms), 4) AS mean,
       max(CASE WHEN r = greatest(1, least(n, CAST(round_even(0.5::DOUBLE * n + 0.5::DOUBLE, 0) AS BIGINT))) THEN ms END) AS p50,
       max(CASE WHEN r = greatest(1, least(n, CAST(round_even(0.95::DOUBLE * n + 0.5::DOUBLE, 0) AS BIGINT))) THEN ms END) AS p95 FROM r""")
def latency_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = M.latency_summary(table(spark, sf_dir, "events"), "value")
    return found.withColumn("total", F.round("total", 4)).withColumn("mean", F.round("mean", 4))


@query("ols_fit", "SELECT round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept, count(*) AS n FROM lineitem")
def ols_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(M.ols_line(table(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice"), 4)
