"""Queries on wordings, ordinal cuts, resampling and run comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import comparison as K
from ..operators import holdout as H
from ..operators import metrics as M
from ..operators import regression as G
from ..operators import splits as P
from ..operators.splits import split_hash_sql
from ..registry import query
from ..sources.tables import table
from .quality import WITH
from .scored import rounded, scored_outcomes

#: Factors of the six wordings' synthetic scores.
FACTORS = (37, 41, 43, 47, 53, 59)
_X = "[" + ", ".join(f"((row_id * {m}) % 101) / 100.0::DOUBLE" for m in FACTORS) + "]"


def wording_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.array(*[(F.col("row_id") * m % 101) / F.lit(100.0) for m in FACTORS])
    return scored_outcomes(spark, sf_dir).withColumn("x", x)


def auc_sql(source: str, keys: str, out: str) -> str:
    """CTEs that end in ``out``: keys and auc of ``source`` (keys, score, gold_bool)."""
    return f"""
{out}_r AS (SELECT {keys}, gold_bool, rank() OVER (PARTITION BY {keys} ORDER BY score) + (count(*) OVER (PARTITION BY {keys}, score) - 1) / 2.0::DOUBLE AS r FROM {source} WHERE gold_bool IS NOT NULL),
{out}_s AS (SELECT {keys}, sum(CASE WHEN gold_bool THEN r END) AS rs, count(*) FILTER (WHERE gold_bool) AS p, count(*) FILTER (WHERE NOT gold_bool) AS n FROM {out}_r GROUP BY {keys}),
{out} AS (SELECT {keys}, CASE WHEN p > 0 AND n > 0 THEN (rs - p * (p + 1) / 2.0::DOUBLE) / (p * n) END AS auc FROM {out}_s)"""


_ENSEMBLE = f"""{WITH},
e AS (SELECT gold_bool, {_X} AS x FROM o WHERE gold_bool IS NOT NULL),
l AS ({" UNION ALL ".join(f"SELECT 'single' AS kind, 'w{i}' AS name, gold_bool, round(x[{i + 1}], 9) AS score FROM e" for i in range(6))}
  UNION ALL SELECT 'aggregated', 'mean', gold_bool, round(list_avg(x), 9) FROM e UNION ALL SELECT 'aggregated', 'median', gold_bool, round(list_median(x), 9) FROM e
  UNION ALL SELECT 'aggregated', 'trimmed', gold_bool, round(list_avg(list_sort(x)[2:5]), 9) FROM e),
{auc_sql("l", "kind, name", "a")},
b AS (SELECT kind, name, avg(CAST((score >= 0.5) = gold_bool AS INT)) AS acc, avg(score) AS m FROM l GROUP BY kind, name)"""


@query("ensemble_mean_median_trimmed", f"{_ENSEMBLE} SELECT b.kind AS kind, b.name AS name, round(auc, 6) AS auc, round(acc, 6) AS accuracy_at_half, round(m, 6) AS mean_score FROM b JOIN a ON a.kind = b.kind AND a.name = b.name")
def ensemble_mean_median_trimmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(K.ensemble(wording_scores(spark, sf_dir), "x", 6))


@query("ensemble_spread", f"""{_ENSEMBLE},
z AS (SELECT min(CASE WHEN kind = 'single' THEN auc END) AS lo, max(CASE WHEN kind = 'single' THEN auc END) AS hi, avg(CASE WHEN kind = 'single' THEN auc END) AS m, max(CASE WHEN name = 'mean' THEN auc END) AS g FROM a)
SELECT round(lo, 6) AS auc_min, round(hi, 6) AS auc_max, round(m, 6) AS auc_mean, round(g, 6) AS auc_of_mean, round(hi - lo, 6) AS spread, CASE WHEN g - m > 0.03 THEN 'helps' WHEN g - m < -0.03 THEN 'hurts' ELSE 'neutral' END AS verdict FROM z""")
def ensemble_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(K.ensemble_spread(K.ensemble(wording_scores(spark, sf_dir), "x", 6)))


_VARIANTS = f"""{WITH},
l AS (SELECT question, 'v1' AS variant, gold_bool, score FROM o UNION ALL SELECT question, 'v2', gold_bool, ((row_id * 41) % 101) / 100.0::DOUBLE FROM o UNION ALL SELECT question, 'v3', gold_bool, (100 - ((row_id * 37) % 101)) / 100.0::DOUBLE FROM o),
{auc_sql("l", "question, variant", "a")},
p AS (SELECT question, max(CASE WHEN variant = 'v1' THEN auc END) AS a1, max(CASE WHEN variant = 'v2' THEN auc END) AS a2, max(CASE WHEN variant = 'v3' THEN auc END) AS a3 FROM a GROUP BY question)"""


def _variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = F.col("row_id") * 37 % 101
    ways = F.array(
        F.struct(F.lit("v1").alias("variant"), F.col("score").alias("s")), F.struct(F.lit("v2").alias("variant"), ((F.col("row_id") * 41 % 101) / F.lit(100.0)).alias("s")),
        F.struct(F.lit("v3").alias("variant"), ((100 - points) / F.lit(100.0)).alias("s")),
    )
    long = scored_outcomes(spark, sf_dir).select("question", "gold_bool", F.explode(ways).alias("w"))
    return K.variant_probe(long.select("question", "gold_bool", "w.variant", F.col("w.s").alias("score")))


@query("variant_shift", f"{_VARIANTS} SELECT question, round(a1, 6) AS auc_v1, round(a2, 6) AS auc_v2, round(a3, 6) AS auc_v3, round(abs(a1 - a2), 6) AS paraphrase_shift, round(1 - a1, 6) AS negation_predicted, abs(a3 - (1 - a1)) <= 0.15 AS inverted FROM p")
def variant_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_variants(spark, sf_dir))


@query("negation_probe", f"""{_VARIANTS} SELECT count(*) AS questions, round(avg(abs(a1 - a2)), 6) AS mean_shift, round(max(abs(a1 - a2)), 6) AS max_shift,
  count(*) FILTER (WHERE abs(a3 - (1 - a1)) <= 0.15) AS inverted, count(*) FILTER (WHERE abs(a3 - (1 - a1)) > 0.15) AS not_inverted FROM p""")
def negation_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(K.variant_summary(_variants(spark, sf_dir)))


#: Orders stand for scripts with a three-band gold label; their answers are three synthetic probabilities.
ORDINAL_SQL = """
q AS (SELECT o_orderkey AS row_id, CASE WHEN o_totalprice < 100000 THEN 0 WHEN o_totalprice < 250000 THEN 1 ELSE 2 END AS level,
             round((30 + (o_orderkey * 7) % 41) / 100.0::DOUBLE * 1 + ((o_orderkey * 3) % 30 + CAST(floor(o_totalprice / 20000) AS BIGINT)) / 100.0::DOUBLE * 2, 3) AS value FROM orders)
"""


def ordinal_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, price = F.col("o_orderkey"), F.col("o_totalprice")
    middle = (30 + k * 7 % 41) / F.lit(100.0)
    high = (k * 3 % 30 + F.floor(price / 20000)) / F.lit(100.0)
    level = F.when(price < 100000, 0).when(price < 250000, 1).otherwise(2).cast("long")
    return table(spark, sf_dir, "orders").select(k.alias("row_id"), level.alias("level"), K.expected_level(F.array(F.lit(0.0), middle, high)).alias("value"), price.alias("price"))


@query("ordinal_expected", f"WITH {ORDINAL_SQL} SELECT row_id, CAST(level AS BIGINT) AS level, value FROM q")
def ordinal_expected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordinal_rows(spark, sf_dir).select("row_id", "level", "value")


def _cuts_sql(rows: str, keys: str, out: str) -> str:
    k, on = (f"{keys}, ", " AND ".join(f"a.{c.strip()} = b.{c.strip()}" for c in keys.split(","))) if keys else ("", "TRUE")
    by = f"PARTITION BY {keys} " if keys else ""
    ak = ", ".join(f"a.{c.strip()} AS {c.strip()}" for c in keys.split(",")) + ", " if keys else ""
    return f"""
{out}_c AS (SELECT {k}value AS v, count(*) FILTER (WHERE level = 0) AS c0, count(*) FILTER (WHERE level = 1) AS c1, count(*) FILTER (WHERE level = 2) AS c2 FROM {rows} GROUP BY {k}value),
{out}_b AS (SELECT *, sum(c0) OVER ({by}ORDER BY v) - c0 AS b0, sum(c1) OVER ({by}ORDER BY v) - c1 AS b1, sum(c2) OVER ({by}ORDER BY v) - c2 AS b2, sum(c2) OVER ({by}) AS all2, sum(c0 + c1 + c2) OVER ({by}) AS n FROM {out}_c),
{out}_p AS (SELECT {ak}a.v AS low, b.v AS high, a.b0 + b.b1 - a.b1 + a.all2 - b.b2 AS hits, a.n AS n FROM {out}_b a JOIN {out}_b b ON {on} AND b.v >= a.v),
{out} AS (SELECT * FROM {out}_p QUALIFY row_number() OVER ({by}ORDER BY hits DESC, low, high) = 1)"""


@query("fit_cuts_insample", f"WITH {ORDINAL_SQL}, {_cuts_sql('q', '', 'f')} SELECT low, high, CAST(hits AS BIGINT) AS hits, CAST(n AS BIGINT) AS n FROM f")
def fit_cuts_insample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.fit_cuts(ordinal_rows(spark, sf_dir).withColumn("g", F.lit(1)), ["g"]).drop("g")


_LEVEL = "CASE WHEN {v} < low THEN 0 WHEN {v} < high THEN 1 ELSE 2 END"
_ERRORS = "round(avg(CAST(abs(d) = 0 AS INT)), 6) AS exact, round(avg(CAST(abs(d) = 1 AS INT)), 6) AS one_band, round(avg(CAST(abs(d) = 2 AS INT)), 6) AS two_bands, round(avg(CAST(abs(d) <= 1 AS INT)), 6) AS within_one, count(*) AS n"


@query("error_structure", f"WITH {ORDINAL_SQL}, {_cuts_sql('q', '', 'f')}, d AS (SELECT {_LEVEL.format(v='value')} - level AS d FROM q, f) SELECT {_ERRORS} FROM d")
def error_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ordinal_rows(spark, sf_dir).withColumn("g", F.lit(1))
    return rounded(K.ordinal_scores(rows, ["g"]).select("exact", "one_band", "two_bands", "within_one", "n"))


_TRIVIAL = f"""WITH {ORDINAL_SQL},
t AS (SELECT 'expected' AS predictor, value, level FROM q UNION ALL SELECT 'weekday', CAST(o_orderkey % 7 AS DOUBLE), level FROM q JOIN orders ON o_orderkey = row_id
  UNION ALL SELECT 'thousands', CAST(floor(o_totalprice / 10000) AS DOUBLE), level FROM q JOIN orders ON o_orderkey = row_id),
{_cuts_sql('t', 'predictor', 'f')},
d AS (SELECT t.predictor AS predictor, {_LEVEL.format(v='t.value')} - level AS d FROM t JOIN f ON f.predictor = t.predictor UNION ALL SELECT 'constant', 1 - level FROM q)
SELECT predictor, {_ERRORS} FROM d GROUP BY predictor"""


@query("trivial_baselines", _TRIVIAL)
def trivial_baselines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Single features under the protocol of the model's answer, and the constant middle band."""
    rows = ordinal_rows(spark, sf_dir)
    way = lambda n, v: F.struct(F.lit(n).alias("predictor"), v.cast("double").alias("value"))
    ways = F.array(way("expected", F.col("value")), way("weekday", F.col("row_id") % 7), way("thousands", F.floor(F.col("price") / 10000)))
    long = rows.select("level", F.explode(ways).alias("w")).select("level", "w.*")
    fitted = K.ordinal_scores(long, ["predictor"]).select("predictor", "exact", "one_band", "two_bands", "within_one", "n")
    constant = K.error_structure(rows.withColumn("predictor", F.lit("constant")).withColumn("predicted", F.lit(1)), ["predictor"])
    return rounded(fitted.unionByName(constant))


_RHO = "rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0"


@query("ranking_signal", f"""WITH {ORDINAL_SQL},
x AS (SELECT level, o_totalprice AS points, value, (o_orderkey * 3) % 30 + floor(o_totalprice / 20000) AS hi, 100 - o_orderkey % 17 AS lo FROM q JOIN orders ON o_orderkey = row_id),
r AS (SELECT {_RHO.format(c='points')} AS rp, {_RHO.format(c='value')} AS rv, {_RHO.format(c='hi')} AS rh, {_RHO.format(c='lo')} AS rl FROM x)
SELECT round(corr(rp, rv), 6) AS rho_value, round(corr(rp, rh), 6) AS rho_high, round(corr(rp, rl), 6) AS rho_low, count(*) AS n FROM r""")
def ranking_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ordinal_rows(spark, sf_dir).withColumn("g", F.lit(1)).withColumn("p_high", F.col("row_id") * 3 % 30 + F.floor(F.col("price") / 20000)).withColumn("p_low", 100 - F.col("row_id") % 17)
    return rounded(M.ranking_signal(rows, ["g"], points="price").drop("g"))


SPLITS, ALL_SPLITS = 8, 500
_K = (
    "((((({id} % 1000003) + 1000003) % 1000003) * 7919 + (CAST(floor({id} / 1000003) AS BIGINT) % 1000003 + 1000003) % 1000003 * 15485863"
    " + s.split * 104729) % 2147483647)"
)
_SPLIT = f"((({_K} * {_K} + s.split) % 2147483647) * 48271 % 2147483647) % 1000 < 500"



def halves_sql(rows: str, out: str, cls: str, splits: int, by: str = "") -> str:
    """CTEs of ``rows`` once for each split, ``tr``: among the half-even half (2 at least) of its class, by hash and row_id."""
    part = f"{by}, {cls}" if by else cls
    return f"""{out}_h AS (SELECT x.*, s.split AS split, {split_hash_sql("x.row_id", "s.split")} AS h FROM {rows} x, (SELECT unnest(range(0, {splits})) AS split) s),
{out} AS (SELECT *, row_number() OVER (PARTITION BY split, {part} ORDER BY h, row_id) <= greatest(2, round_even(count(*) OVER (PARTITION BY split, {part}) / 2, 0)) AS tr FROM {out}_h)"""


@query("stratified_halves", f"""{WITH}, g AS (SELECT row_id, question, gold_bool FROM o WHERE gold_bool IS NOT NULL AND question IS NOT NULL),
e AS (SELECT question FROM g GROUP BY question HAVING count(*) FILTER (WHERE gold_bool) > 0 AND count(*) FILTER (WHERE NOT gold_bool) > 0),
p AS (SELECT g.* FROM g JOIN e ON e.question = g.question), {halves_sql('p', 'w', 'gold_bool', SPLITS, 'question')}
SELECT question, row_id, gold_bool, split, tr AS is_train FROM w""")
def stratified_halves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every graded document's half in each split, exactly half of each class of each question."""
    rows = scored_outcomes(spark, sf_dir).where("question IS NOT NULL").select("question", "row_id", "gold_bool")
    return P.stratified_splits(rows, ["question"], "gold_bool", "row_id", SPLITS)


@query("holdout_threshold", f"""{WITH}, g AS (SELECT row_id, score, gold_bool FROM o WHERE gold_bool IS NOT NULL),
{halves_sql('g', 'w', 'gold_bool', SPLITS)},
u AS (SELECT * FROM w WHERE tr),
cand AS (SELECT split, score AS threshold FROM u UNION SELECT split, 0.0::DOUBLE FROM u UNION SELECT split, 1.0::DOUBLE FROM u),
acc AS (SELECT c.split, c.threshold, i.inverted, count(*) FILTER (WHERE ((u.score >= c.threshold) <> i.inverted) = u.gold_bool) AS hits, count(*) AS n FROM cand c JOIN u ON u.split = c.split, (VALUES (FALSE), (TRUE)) i(inverted) GROUP BY 1, 2, 3),
rk AS (SELECT *, hits / n AS a, max(hits / n) OVER (PARTITION BY split) AS top, row_number() OVER (PARTITION BY split, hits ORDER BY threshold, inverted) AS rf, row_number() OVER (PARTITION BY split, hits ORDER BY threshold DESC, inverted DESC) AS rl FROM acc),
best AS (SELECT * FROM rk WHERE a = top AND CASE WHEN round(top, 4) < top THEN rl = 1 ELSE rf = 1 END)
SELECT w.split AS split, best.threshold AS threshold, best.inverted AS inverted, round(max(best.a), 6) AS train_accuracy, round(avg(CAST(((w.score >= best.threshold) <> best.inverted) = w.gold_bool AS INT)), 6) AS test_accuracy, count(*) AS n_test
FROM w JOIN best ON best.split = w.split WHERE NOT w.tr GROUP BY 1, 2, 3""")
def holdout_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(H.threshold_halves(scored_outcomes(spark, sf_dir), [], "row_id", SPLITS))


_BEST = """acc AS (SELECT question, split, s AS threshold, inverted, CASE WHEN inverted THEN tp + tn - (tp - pb + nb) ELSE tp - pb + nb END AS hits, tp + tn AS n FROM b, (VALUES (FALSE), (TRUE)) i(inverted)),
rk AS (SELECT *, hits / n AS a, max(hits / n) OVER (PARTITION BY question, split) AS top, row_number() OVER (PARTITION BY question, split, hits ORDER BY threshold, inverted) AS rf, row_number() OVER (PARTITION BY question, split, hits ORDER BY threshold DESC, inverted DESC) AS rl FROM acc),
best AS (SELECT * FROM rk WHERE a = top AND CASE WHEN round(top, 4) < top THEN rl = 1 ELSE rf = 1 END)"""


@query("holdout_summary", f"""{WITH}, g AS (SELECT question, row_id, score, gold_bool FROM o WHERE gold_bool IS NOT NULL),
e AS (SELECT question FROM g GROUP BY question HAVING count(*) FILTER (WHERE gold_bool) >= 4 AND count(*) FILTER (WHERE NOT gold_bool) >= 4),
p AS (SELECT g.* FROM g JOIN e ON e.question IS NOT DISTINCT FROM g.question), {halves_sql('p', 'w', 'gold_bool', ALL_SPLITS, 'question')},
every AS (SELECT question, split, score AS s, CAST(gold_bool AS INT) AS pos, CAST(NOT gold_bool AS INT) AS neg FROM w WHERE tr
  UNION ALL SELECT question, -1, score, CAST(gold_bool AS INT), CAST(NOT gold_bool AS INT) FROM p),
ends AS (SELECT DISTINCT question, split, unnest([0.0::DOUBLE, 1.0::DOUBLE]) AS s FROM every),
c AS (SELECT question, split, s, sum(pos) AS pos, sum(neg) AS neg FROM (SELECT * FROM every UNION ALL SELECT question, split, s, 0, 0 FROM ends) GROUP BY question, split, s),
b AS (SELECT *, sum(pos) OVER (PARTITION BY question, split ORDER BY s) - pos AS pb, sum(neg) OVER (PARTITION BY question, split ORDER BY s) - neg AS nb,
        sum(pos) OVER (PARTITION BY question, split) AS tp, sum(neg) OVER (PARTITION BY question, split) AS tn FROM c), {_BEST},
t AS (SELECT w.question AS question, w.split AS split, best.threshold AS threshold, avg(CAST(((w.score >= best.threshold) <> best.inverted) = w.gold_bool AS INT)) AS acc
  FROM w JOIN best ON best.split = w.split AND best.question IS NOT DISTINCT FROM w.question WHERE NOT w.tr GROUP BY 1, 2, 3),
l AS (SELECT question, count(*) AS n, avg(acc) AS m, list_sort(list(acc)) AS v, list_sort(list(threshold)) AS cut FROM t GROUP BY question),
h AS (SELECT question, avg(CAST((score >= 0.5) = gold_bool AS INT)) AS half FROM p GROUP BY question)
SELECT l.question AS question, l.n AS n, round(m, 6) AS mean, round(v[CAST(floor(0.05 * l.n) AS BIGINT) + 1], 6) AS p05, round(v[least(l.n - 1, CAST(floor(0.95 * l.n) AS BIGINT)) + 1], 6) AS p95,
  round(cut[CAST(floor(l.n / 2) AS BIGINT) + 1], 6) AS median_threshold, round(cut[1], 6) AS least_threshold, round(cut[l.n], 6) AS largest_threshold,
  round(half, 6) AS accuracy_at_half, round(best.a, 6) AS hindsight, round(best.a - m, 6) AS gap, round(m - half, 6) AS gain
FROM l JOIN h ON h.question IS NOT DISTINCT FROM l.question JOIN best ON best.question IS NOT DISTINCT FROM l.question AND best.split = -1""")
def holdout_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every question's threshold on 500 halves."""
    return rounded(K.holdout_summary(scored_outcomes(spark, sf_dir), "row_id", ALL_SPLITS, ["question"]))


@query("holdout_majority", f"""{WITH},
w AS (SELECT s.split AS split, gold_bool, {_SPLIT.format(id='row_id')} AS tr FROM o, (SELECT unnest(range(0, 100)) AS split) s WHERE gold_bool IS NOT NULL),
c AS (SELECT split, 2 * count(*) FILTER (WHERE gold_bool) >= count(*) AS call FROM w WHERE tr GROUP BY split),
a AS (SELECT w.split, avg(CAST(gold_bool = call AS INT)) AS acc FROM w JOIN c ON c.split = w.split WHERE NOT tr GROUP BY w.split),
l AS (SELECT list_sort(list(acc)) AS v, avg(acc) AS m, count(*) AS n FROM a)
SELECT n, round(m, 6) AS mean, round(v[CAST(floor(0.05 * n) AS BIGINT) + 1], 6) AS p05, round(v[least(n - 1, CAST(floor(0.95 * n) AS BIGINT)) + 1], 6) AS p95 FROM l""")
def holdout_majority(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = K.hash_splits(scored_outcomes(spark, sf_dir).where("gold_bool IS NOT NULL"), "row_id", 100)
    return rounded(K.spread(K.majority_holdout(rows), "test_accuracy"))


@query("fit_cuts_holdout", f"""WITH {ORDINAL_SQL},
w AS (SELECT s.split AS split, row_id, level, value, {_SPLIT.format(id='row_id')} AS tr FROM q, (SELECT unnest(range(0, {SPLITS})) AS split) s),
u AS (SELECT * FROM w WHERE tr), {_cuts_sql('u', 'split', 'f')},
d AS (SELECT w.split AS split, {_LEVEL.format(v='w.value')} - level AS d FROM w JOIN f ON f.split = w.split WHERE NOT tr)
SELECT split, {_ERRORS} FROM d GROUP BY split""")
def fit_cuts_holdout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(K.cuts_holdout(K.hash_splits(ordinal_rows(spark, sf_dir), "row_id", SPLITS)))


@query("run_compare", f"""{WITH},
j AS (SELECT question, score AS l, ((row_id * 41) % 101) / 100.0::DOUBLE AS r, gold_bool FROM o WHERE gold_bool IS NOT NULL AND row_id % 7 <> 0),
x AS (SELECT question, l AS score, gold_bool FROM j), y AS (SELECT question, r AS score, gold_bool FROM j), {auc_sql('x', 'question', 'al')}, {auc_sql('y', 'question', 'ar')},
b AS (SELECT question, count(*) AS n, avg(CAST((l >= 0.5) = gold_bool AS INT)) AS la, avg(CAST((r >= 0.5) = gold_bool AS INT)) AS ra, avg(l) AS lm, avg(r) AS rm,
        count(*) FILTER (WHERE (r >= 0.5) = gold_bool AND (l >= 0.5) <> gold_bool) AS ro, count(*) FILTER (WHERE (l >= 0.5) = gold_bool AND (r >= 0.5) <> gold_bool) AS lo FROM j GROUP BY question),
t AS (SELECT question, sum(exp(lgamma(ro + lo + 1) - lgamma(i + 1) - lgamma(ro + lo - i + 1) - (ro + lo) * ln(2.0::DOUBLE))) AS tail FROM b, LATERAL (SELECT unnest(range(0, least(ro, lo) + 1)) AS i) GROUP BY question)
SELECT b.question AS question, n, round(la, 6) AS left_accuracy, round(ra, 6) AS right_accuracy, round(lm, 6) AS left_mean, round(rm, 6) AS right_mean, ro AS right_only, lo AS left_only,
  round(CASE WHEN ro + lo = 0 THEN 1.0 ELSE least(1.0, 2 * tail) END, 6) AS p, round(al.auc, 6) AS left_auc, round(ar.auc, 6) AS right_auc
FROM b JOIN t ON t.question = b.question JOIN al ON al.question = b.question JOIN ar ON ar.question = b.question""")
def run_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs; the second did not answer every seventh document."""
    o = scored_outcomes(spark, sf_dir).withColumnRenamed("row_id", "origin")
    right = o.where("origin % 7 <> 0").select("origin", "question", ((F.col("origin") * 41 % 101) / F.lit(100.0)).alias("score"))
    return rounded(K.compare_runs(o.select("origin", "question", "score"), right, o.select("origin", "question", "gold_bool")))


@query("strategy_question", f"""{WITH}, u AS (SELECT predicted, gold FROM o WHERE gold IS NOT NULL)
SELECT n, hits, distinct_predictions, round(hits / n, 6) AS accuracy, round(m / n, 6) AS majority,
  round(greatest(0, (hits / n + 3.8416 / (2 * n) - 1.96 * sqrt(hits / n * (1 - hits / n) / n + 3.8416 / (4.0 * n * n))) / (1 + 3.8416 / n)), 6) AS low,
  round(least(1, (hits / n + 3.8416 / (2 * n) + 1.96 * sqrt(hits / n * (1 - hits / n) / n + 3.8416 / (4.0 * n * n))) / (1 + 3.8416 / n)), 6) AS high
FROM (SELECT count(*) AS n, count(*) FILTER (WHERE predicted = gold) AS hits, count(DISTINCT predicted) AS distinct_predictions, (SELECT max(c) FROM (SELECT count(*) AS c FROM u GROUP BY gold)) AS m FROM u)""")
def strategy_question(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(K.strategy_score(scored_outcomes(spark, sf_dir), "predicted", "gold"))


def supplier_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as a small corpus: counts of their lines as features, above-median returns as the label."""
    per = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("row_id")).agg(
        F.count(F.lit(1)).alias("n_lines"), F.count_if(F.col("l_returnflag") == "R").alias("n_returned"), F.countDistinct("l_partkey").alias("n_parts"), F.sum(F.col("l_quantity").cast("long")).alias("quantity"),
    )
    label = F.col("n_returned") * 3 > F.col("n_lines")
    return per.withColumn("gold", label).withColumn("score", (F.col("row_id") * 37 % 101) / F.lit(100.0))


_FEATURES = ["n_lines", "n_returned", "n_parts", "quantity"]


@query("logistic_loo")
def logistic_loo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Out-of-fold probabilities with and without the features that define the label."""
    found = G.leave_one_out(supplier_rows(spark, sf_dir), _FEATURES, "gold", "row_id", {"clean": ["n_returned"], "leaky": []})
    return found.withColumn("p", F.round("p", 6))


@query("regression_baseline")
def regression_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The suppliers' score against leave-one-out regressions with and without the feature that defines the label."""
    return rounded(G.baseline(supplier_rows(spark, sf_dir), _FEATURES, "gold", "row_id", ["n_returned"], "score"))


@query("paired_compare")
def paired_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The score against regressions of 200 stratified halves."""
    return rounded(G.paired_summary(G.paired_splits(supplier_rows(spark, sf_dir), 200, _FEATURES, "gold", "score", "row_id", ["n_returned"])))


@query("logistic_fit")
def logistic_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coefficients of the models of all suppliers."""
    return rounded(G.fit_table(supplier_rows(spark, sf_dir), _FEATURES, "gold", "row_id", {"clean": ["n_returned"], "leaky": []}))


_SUPPLIERS = """s AS (
  SELECT l_suppkey AS row_id, CAST(count(*) AS DOUBLE) AS n_lines, CAST(count(*) FILTER (WHERE l_returnflag = 'R') AS DOUBLE) AS n_returned,
         CAST(count(DISTINCT l_partkey) AS DOUBLE) AS n_parts, CAST(sum(CAST(l_quantity AS BIGINT)) AS DOUBLE) AS quantity
  FROM lineitem GROUP BY l_suppkey)"""


@query("gram_matrix", f"""WITH {_SUPPLIERS}, z AS ({" UNION ALL ".join(f"SELECT row_id, '{f}' AS f, {i} AS k, ({f} - avg({f}) OVER ()) / coalesce(nullif(stddev_pop({f}) OVER (), 0), 1) AS x FROM s" for i, f in enumerate(_FEATURES))})
SELECT a.f AS feature, b.f AS other, round(sum(a.x * b.x), 6) AS product FROM z a JOIN z b ON a.row_id = b.row_id AND a.k <= b.k GROUP BY a.f, b.f""")
def gram_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums of products of scaled features: the matrix of a Newton step from zero, four times."""
    data = G.design(supplier_rows(spark, sf_dir), _FEATURES, "gold", "row_id")
    every = list(range(len(_FEATURES)))
    matrix = 4 * G.newton_sums(data, G.Everyone(), {"all": every}, {"all": G.np.zeros((1, len(every) + 1))})["all"][0][0]
    made = [(_FEATURES[i], _FEATURES[j], float(matrix[i + 1, j + 1])) for i in every for j in every if i <= j]
    return rounded(spark.createDataFrame(made, "feature string, other string, product double"))
