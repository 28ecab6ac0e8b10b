"""Queries on corpus statistics: profiles, percentile positions, histograms, bands."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.workspace import write_table
from ..operators import rubric as R
from ..operators.profile import PERCENTILES, percentiles, profile
from ..operators.ranking import sum_before
from ..registry import query
from ..sources.tables import table

PERCENTILE_SQL = ", ".join(
    f"max(CASE WHEN r = greatest(1, least(n, CAST(round_even({p / 100!r}::DOUBLE * n + 0.5::DOUBLE, 0) AS BIGINT))) THEN value END) AS p{p}"
    for p in PERCENTILES
)


def profile_sql(source: str, columns: list[str]) -> str:
    cells = " UNION ALL ".join(f"SELECT '{c}' AS feature, coalesce(CAST({c} AS DOUBLE), 0) AS value FROM {source}" for c in columns)
    return f"""
WITH c AS ({cells}),
r AS (SELECT feature, value, row_number() OVER (PARTITION BY feature ORDER BY value) AS r,
             count(*) OVER (PARTITION BY feature) AS n FROM c)
SELECT feature, max(n) AS n, min(value) AS min, max(value) AS max, round(avg(value), 4) AS mean,
       round(coalesce(stddev_samp(value), 0), 4) AS stdev, count(*) FILTER (WHERE value = 0) AS zeros, {PERCENTILE_SQL}
FROM r GROUP BY feature
"""


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("mean", F.round("mean", 4)).withColumn("stdev", F.round("stdev", 4))


_LINEITEM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"]


@query("profile_lineitem", profile_sql("lineitem", _LINEITEM))
def profile_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(profile(table(spark, sf_dir, "lineitem"), _LINEITEM, stored=True))


_ORDERS = ["o_totalprice", "o_custkey"]


@query("profile_orders", profile_sql("orders", _ORDERS))
def profile_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(profile(table(spark, sf_dir, "orders"), _ORDERS, stored=True))


@query("profile_documents", profile_sql("documents", ["n_chars"]))
def profile_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(profile(table(spark, sf_dir, "documents"), ["n_chars"], stored=True))


@query("percentile_rank_part", """
SELECT p_partkey, CAST(round_even(100 * cume_dist() OVER (PARTITION BY p_type ORDER BY p_retailprice), 0) AS BIGINT) AS percentile FROM part""")
def percentile_rank_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentile position of each part's price among those of its type."""
    return R.percentile_rank(table(spark, sf_dir, "part"), ["p_type"], "p_retailprice", "percentile").select("p_partkey", "percentile")


@query("cume_position_customer", """
SELECT c_custkey, CAST(round_even(100 * cume_dist() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal), 0) AS BIGINT) AS percentile FROM customer""")
def cume_position_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.percentile_rank(table(spark, sf_dir, "customer"), ["c_mktsegment"], "c_acctbal", "percentile").select("c_custkey", "percentile")


@query("histogram_price", """
WITH e AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem),
b AS (SELECT CAST(least(7, floor((l_extendedprice - lo) / ((hi - lo) / 8))) AS BIGINT) AS bin, count(*) AS c FROM lineitem, e GROUP BY 1)
SELECT CAST(r.i AS BIGINT) AS bin, round(lo + r.i * (hi - lo) / 8, 4) AS start, coalesce(c, 0) AS n FROM range(8) r(i) CROSS JOIN e LEFT JOIN b ON b.bin = r.i""")
def histogram_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = R.histogram(table(spark, sf_dir, "lineitem"), "l_extendedprice", 8)
    return found.withColumn("start", F.round("start", 4))


#: Orders stand for scripts: counts over their lines are the structural features.
FEATURES_SQL = """
f AS (SELECT o_orderkey AS name, o_orderpriority AS pool, count(l_orderkey) AS n_lines, count(DISTINCT l_partkey) AS n_parts, count(DISTINCT l_suppkey) AS n_suppliers,
             count(*) FILTER (WHERE l_returnflag = 'R') AS n_returned, CAST(coalesce(sum(CAST(l_quantity AS BIGINT)), 0) AS BIGINT) AS quantity
      FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2)
"""
FEATURES = ["n_lines", "n_parts", "n_suppliers", "n_returned", "quantity"]
SCORED = [("n_lines", 66, 90), ("n_parts", 50, 90), ("n_suppliers", 66, 90), ("n_returned", 66, None), ("quantity", 90, None)]
FLAT = [("has_returns", "n_returned > 2"), ("single_line", "n_lines = 1")]


def order_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Dealt once by order; counts of one distinct value at a time need no other exchange, nor does their join.
    dealt = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("name"), "l_partkey", "l_suppkey", "l_returnflag", "l_quantity").repartition("name")
    parts = dealt.groupBy("name").agg(
        F.count(F.lit(1)).alias("n_lines"), F.countDistinct("l_partkey").alias("n_parts"), F.count_if(F.col("l_returnflag") == "R").alias("n_returned"), F.sum(F.col("l_quantity").cast("long")).alias("quantity"),
    )
    suppliers = dealt.groupBy("name").agg(F.countDistinct("l_suppkey").alias("n_suppliers"))
    lines = parts.join(suppliers, "name").select("name", *FEATURES)
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("name"), F.col("o_orderpriority").alias("pool"))
    return orders.join(lines, "name", "left").na.fill(0, FEATURES)


def _nearest(p: int) -> str:
    return f"max(CASE WHEN r = greatest(1, least(n, CAST(round_even({p / 100!r}::DOUBLE * n + 0.5::DOUBLE, 0) AS BIGINT))) THEN value END)"


THRESHOLDS_SQL = (
    "c AS ("
    + " UNION ALL ".join(f"SELECT '{x}' AS feature, {x} AS value FROM f" for x in FEATURES)
    + "), r AS (SELECT feature, value, row_number() OVER (PARTITION BY feature ORDER BY value) AS r, count(*) OVER (PARTITION BY feature) AS n FROM c), t0 AS ("
    + " UNION ALL ".join(f"SELECT feature, greatest({_nearest(lo)}, 1) AS lower, {_nearest(hi) if hi else 'NULL'} AS up FROM r WHERE feature = '{x}' GROUP BY feature" for x, lo, hi in SCORED)
    + "), t AS (SELECT feature, CAST(lower AS BIGINT) AS lower, CAST(CASE WHEN up IS NOT NULL THEN greatest(up, lower + 1) END AS BIGINT) AS upper FROM t0)"
)


@query("thresholds_from_percentiles", f"WITH {FEATURES_SQL}, {THRESHOLDS_SQL} SELECT feature, lower, upper FROM t")
def thresholds_from_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.thresholds(order_features(spark, sf_dir), SCORED)


_TIER = "coalesce(CASE WHEN {f} >= (SELECT upper FROM t WHERE feature = '{f}') THEN 2 END, CASE WHEN {f} >= (SELECT lower FROM t WHERE feature = '{f}') THEN 1 END, 0)"
POINTS_SQL = (
    "p AS (SELECT f.*, CAST(" + " + ".join(_TIER.format(f=x) for x, _, _ in SCORED) + " + " + " + ".join(f"CASE WHEN {c} THEN 1 ELSE 0 END" for _, c in FLAT) + " AS BIGINT) AS points FROM f)"
)
BANDS = [("low", 0, 4), ("medium", 5, 6), ("high", 7, None)]
BAND_SQL = "CASE WHEN points <= 4 THEN 'low' WHEN points <= 6 THEN 'medium' ELSE 'high' END"


def scored_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Read by the thresholds and by the score.
    f = write_table(order_features(spark, sf_dir), "features")
    return R.band_for(R.score(f, R.thresholds(f, SCORED, stored=True), FLAT), BANDS)


@query("rubric_score_orders", f"WITH {FEATURES_SQL}, {THRESHOLDS_SQL}, {POINTS_SQL} SELECT name, points FROM p")
def rubric_score_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored_orders(spark, sf_dir).select("name", "points")


@query("rubric_band_orders", f"WITH {FEATURES_SQL}, {THRESHOLDS_SQL}, {POINTS_SQL} SELECT {BAND_SQL} AS band, count(*) AS n, min(points) AS least, max(points) AS most FROM p GROUP BY 1")
def rubric_band_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored_orders(spark, sf_dir).groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.min("points").alias("least"), F.max("points").alias("most"))


_REASON = " , ".join(
    f"CASE WHEN {x} >= (SELECT upper FROM t WHERE feature = '{x}') THEN '{x}=' || {x} || ' (+2)' WHEN {x} >= (SELECT lower FROM t WHERE feature = '{x}') THEN '{x}=' || {x} || ' (+1)' END" for x, _, _ in SCORED
) + " , " + " , ".join(f"CASE WHEN {c} THEN '{n} (+1)' END" for n, c in FLAT)


@query("rubric_reasons_orders", f"WITH {FEATURES_SQL}, {THRESHOLDS_SQL} SELECT name, concat_ws('; ', {_REASON}) AS reasons FROM f")
def rubric_reasons_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored_orders(spark, sf_dir).select("name", F.concat_ws("; ", "reasons").alias("reasons"))


@query("band_distribution", f"WITH {FEATURES_SQL}, {THRESHOLDS_SQL}, {POINTS_SQL} SELECT {BAND_SQL} AS band, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM p), 4) AS percent FROM p GROUP BY 1")
def band_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = R.distribution(scored_orders(spark, sf_dir), "band")
    return found.withColumn("percent", F.round("percent", 4))


@query("choose_bands", f"""WITH {FEATURES_SQL}, {THRESHOLDS_SQL}, {POINTS_SQL},
h AS (SELECT v.i AS points, (SELECT count(*) FROM p WHERE p.points <= v.i) AS upto FROM range(0, (SELECT max(points) FROM p) + 1) v(i)),
n AS (SELECT count(*) AS n FROM p),
pairs AS (SELECT a.points AS t1, b.points AS t2, a.upto AS low, b.upto - a.upto AS medium, n.n - b.upto AS high,
  abs(a.upto - n.n / 3) + abs(b.upto - a.upto - n.n / 3) + abs(n.n - b.upto - n.n / 3) AS cost FROM h a, h b, n WHERE b.points >= a.points + 2 AND b.upto > a.upto AND n.n > b.upto)
SELECT CAST(t1 AS BIGINT) AS t1, CAST(t2 AS BIGINT) AS t2, low, medium, high FROM pairs ORDER BY round(cost, 6), t1, t2 LIMIT 1""")
def choose_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.choose_bands(scored_orders(spark, sf_dir), "points")


@query("band_gaps", f"""WITH {FEATURES_SQL}, {THRESHOLDS_SQL}, {POINTS_SQL},
b AS (SELECT pool, {BAND_SQL} AS band, CASE pool WHEN '1-URGENT' THEN 'high' WHEN '5-LOW' THEN 'low' ELSE 'medium' END AS expected FROM p)
SELECT pool, band, CAST(abs(list_position(['low', 'medium', 'high'], band) - list_position(['low', 'medium', 'high'], expected)) AS BIGINT) AS gap, count(*) AS n FROM b GROUP BY 1, 2, 3""")
def band_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    expected = F.when(F.col("pool") == "1-URGENT", "high").when(F.col("pool") == "5-LOW", "low").otherwise("medium")
    gap = R.band_distance(F.col("band"), expected).cast("long")
    return scored_orders(spark, sf_dir).groupBy("pool", "band", gap.alias("gap")).agg(F.count(F.lit(1)).alias("n"))


@query("top_and_bottom", f"""WITH {FEATURES_SQL}, {THRESHOLDS_SQL}, {POINTS_SQL}
(SELECT 'top' AS side, row_number() OVER (ORDER BY points DESC, name) AS position, name, points FROM p ORDER BY points DESC, name LIMIT 12)
UNION ALL (SELECT 'bottom', row_number() OVER (ORDER BY points, name DESC), name, points FROM p ORDER BY points, name DESC LIMIT 8)""")
def top_and_bottom(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report's lists of the 12 highest and 8 lowest scores."""
    return R.extremes(scored_orders(spark, sf_dir), "name", "points", 12, 8)


@query("marker_frequency", """
SELECT event_type AS marker, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM events), 4) AS percent FROM events GROUP BY 1""")
def marker_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = R.distribution(table(spark, sf_dir, "events").withColumnRenamed("event_type", "marker"), "marker")
    return found.withColumn("percent", F.round("percent", 4))
