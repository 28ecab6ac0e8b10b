"""Queries on sampling, families and migration labels: orders and parts stand for scripts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import labels as L
from ..operators import sampling as S
from ..operators import training as T
from ..registry import query
from ..sources.tables import table
from .statistics import BAND_SQL, FEATURES, FEATURES_SQL, POINTS_SQL, THRESHOLDS_SQL, scored_orders

_P = f"WITH {FEATURES_SQL}, {THRESHOLDS_SQL}, {POINTS_SQL}, b AS (SELECT *, {BAND_SQL} AS band FROM p)"


@query("stratified_quota", f"""{_P},
s AS (SELECT band, count(*) AS size, CAST(floor(100 * count(*) / sum(count(*)) OVER ()) AS BIGINT) AS base, row_number() OVER (ORDER BY count(*) DESC, band) AS place FROM b GROUP BY band)
SELECT band, size, CAST(base + CASE WHEN place <= 100 - (SELECT sum(base) FROM s) THEN 1 ELSE 0 END AS BIGINT) AS quota FROM s""")
def stratified_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.quotas(scored_orders(spark, sf_dir), "band", 100)


@query("forced_maxima", f"WITH {FEATURES_SQL} " + " UNION ALL ".join(f"SELECT * FROM (SELECT '{m}' AS metric, name, {m} AS value FROM f ORDER BY {m} DESC, name DESC LIMIT 1)" for m in FEATURES))
def forced_maxima(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.forced_maxima(scored_orders(spark, sf_dir), "name", FEATURES)


@query("boundary_rows", f"""{_P} SELECT CAST(c.cut AS BIGINT) AS cut, c.side AS side, count(*) AS n FROM b JOIN (VALUES (4, 'below', 4), (4, 'above', 5), (6, 'below', 6), (6, 'above', 7)) c(cut, side, at_) ON points = c.at_ GROUP BY 1, 2""")
def boundary_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.boundary_rows(scored_orders(spark, sf_dir), "points", [4, 6])


@query("coverage_summary", f"""{_P}, rk AS (SELECT points, row_number() OVER (ORDER BY points) AS r, count(*) OVER () AS n FROM b)
SELECT max(n) AS n, (SELECT count(DISTINCT band) FROM b) AS bands, min(points) AS least, max(points) AS most, max(CASE WHEN r = greatest(1, least(n, CAST(round_even(0.9::DOUBLE * n + 0.5::DOUBLE, 0) AS BIGINT))) THEN points END) AS p90 FROM rk""")
def coverage_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.coverage_summary(scored_orders(spark, sf_dir), "band", "points")


@query("stratified_sample", f"""{_P},
ss AS (SELECT band, count(*) AS size, CAST(floor(100 * count(*) / sum(count(*)) OVER ()) AS BIGINT) AS base, row_number() OVER (ORDER BY count(*) DESC, band) AS place FROM b GROUP BY band),
sq AS (SELECT band, base + CASE WHEN place <= 100 - (SELECT sum(base) FROM ss) THEN 1 ELSE 0 END AS quota FROM ss),
sz AS (SELECT band, points, row_number() OVER (PARTITION BY band ORDER BY points) AS low, row_number() OVER (PARTITION BY band ORDER BY points DESC) AS high FROM (SELECT DISTINCT band, points FROM b)),
sr AS (SELECT name, band, points, row_number() OVER (PARTITION BY band, points ORDER BY md5('42|' || CAST(name AS VARCHAR)), name) AS round_ FROM b),
sx AS (SELECT sr.*, row_number() OVER (PARTITION BY sr.band ORDER BY round_, CASE WHEN low <= high THEN 2 * low - 1 ELSE 2 * high END, name) AS turn FROM sr JOIN sz ON sz.band = sr.band AND sz.points = sr.points)
SELECT sx.name AS name, sx.band AS band, sx.points AS points FROM sx JOIN sq ON sq.band = sx.band WHERE sx.turn <= sq.quota""")
def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sample of 100 orders: bands by quota, scores in turns (sampling operator)."""
    return S.stratified_fill(scored_orders(spark, sf_dir).select("name", "band", "points"), "name", "band", "points", 100).select("name", "band", "points")


#: Parts stand for scripts whose families are brand, type and size.
FAMILY_SQL = """
k AS (SELECT p_partkey AS id, substr(sha1('source_tables=' || p_size || '|subquery_count=' || p_size % 3 || '|cte_count=0|window_function_count=0|set_operation_count=0|max_nesting_depth=0|graph_edges=0|statements=1|sources=' ||
        CASE WHEN p_brand < p_type THEN p_brand || ',' || p_type ELSE p_type || ',' || p_brand END), 1, 12) AS family FROM part)
"""


def part_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_size").alias("source_tables"), (F.col("p_size") % 3).alias("subquery_count"), F.lit(1).alias("statements"), F.array("p_brand", "p_type").alias("distinct_sources")
    )
    return p.withColumn("family", T.family_key(p.columns))


@query("family_key_sha1", f"WITH {FAMILY_SQL} SELECT id, family FROM k")
def family_key_sha1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return part_cases(spark, sf_dir).select("id", "family")


@query("family_sizes", f"WITH {FAMILY_SQL}, s AS (SELECT family, count(*) AS n FROM k GROUP BY family) SELECT n AS size, count(*) AS families FROM s GROUP BY n")
def family_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return part_cases(spark, sf_dir).groupBy("family").agg(F.count(F.lit(1)).alias("size")).groupBy("size").agg(F.count(F.lit(1)).alias("families"))


@query("family_split", f"""WITH RECURSIVE {FAMILY_SQL},
s AS (SELECT family, count(*) AS n FROM k GROUP BY family),
r AS (SELECT *, row_number() OVER (ORDER BY n DESC, md5('42|' || family), family) AS i, row_number() OVER (PARTITION BY n ORDER BY md5('42|' || family), family) - 1 AS place FROM s),
t AS (SELECT 0.7::DOUBLE * sum(n) AS x, 0.1::DOUBLE * sum(n) AS y, 0.2::DOUBLE * sum(n) AS z FROM s),
g AS (
  SELECT CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS a, CAST(0 AS BIGINT) AS b, CAST(0 AS BIGINT) AS c, 0 AS way
  UNION ALL
  SELECT i, n, CASE WHEN way = 1 THEN a + n ELSE a END, CASE WHEN way = 2 THEN b + n ELSE b END, CASE WHEN way = 3 THEN c + n ELSE c END, way
  FROM (SELECT r.i AS i, r.n AS n, a, b, c, CASE WHEN a - x <= b - y AND a - x <= c - z THEN 1 WHEN b - y <= c - z THEN 2 ELSE 3 END AS way FROM g JOIN r ON r.i = g.i + 1, t)
),
w AS (SELECT n, way, count(*) AS m FROM g WHERE i > 0 GROUP BY n, way),
e AS (SELECT n, way, sum(m) OVER (PARTITION BY n ORDER BY way) AS upto, m FROM w)
SELECT k.id AS id, k.family AS family, CASE way WHEN 1 THEN 'train' WHEN 2 THEN 'calibration' ELSE 'test' END AS split
FROM k JOIN r ON r.family = k.family JOIN e ON e.n = r.n AND r.place >= e.upto - e.m AND r.place < e.upto""")
def family_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.split_families(part_cases(spark, sf_dir)).select("id", "family", "split")


@query("family_overlap", f"WITH {FAMILY_SQL} SELECT CAST(0 AS BIGINT) AS overlap, count(*) AS cases, count(DISTINCT family) AS families FROM k")
def family_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of the split report: no family may be in two splits."""
    return T.split_report(T.split_families(part_cases(spark, sf_dir))).agg(F.sum("overlap").alias("overlap"), F.sum("cases").alias("cases"), F.sum("families").alias("families"))


#: Two sides of a migration made from parts: what changes, changes by rule.
LABEL_SQL = """
s AS (SELECT p_partkey AS name, p_size % 4 AS b_sub, CASE WHEN p_partkey % 3 = 0 THEN (p_size + 1) % 4 ELSE p_size % 4 END AS a_sub, p_partkey % 2 AS b_cte, CASE WHEN p_partkey % 5 = 0 THEN 1 - p_partkey % 2 ELSE p_partkey % 2 END AS a_cte,
        p_partkey % 11 = 0 AS added, p_partkey % 22 = 0 AS swapped, p_partkey % 17 <> 0 AS ok, p_partkey % 7 = 0 AS marker FROM part),
c AS (SELECT *, CASE WHEN swapped THEN 3 WHEN added THEN 1 ELSE 0 END AS churn, CASE WHEN b_sub <> a_sub THEN 1 ELSE 0 END + CASE WHEN b_cte <> a_cte THEN 1 ELSE 0 END AS shape FROM s),
d AS (SELECT name, CASE WHEN NOT ok THEN 'manual_rewrite' WHEN churn > 2 THEN 'manual_rewrite' WHEN churn > 0 THEN 'redesign' WHEN shape > 0 THEN 'refactor' ELSE 'lift_and_shift' END AS strategy,
        CASE WHEN NOT ok THEN 'low' WHEN churn > 1 THEN 'high' WHEN churn > 0 THEN 'medium' WHEN shape >= 2 THEN 'high' WHEN shape > 0 THEN 'medium' WHEN marker THEN 'high' ELSE 'medium' END AS confidence FROM c)
"""


def migrations(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("name"), F.col("p_size").alias("size"))
    n = F.col("name")
    marks = F.when(n % 7 == 0, F.array(F.lit("rollup"))).otherwise(F.array().cast("array<string>"))
    side = lambda sub, cte, sources, ok, m: p.select("name", sub.alias("subquery_count"), cte.alias("cte_count"), sources.alias("distinct_sources"), ok.alias("parse_ok"), F.lit("spark").alias("parse_dialect"), m.alias("nonportable_markers"))
    before = side(F.col("size") % 4, n % 2, F.array(F.lit("a"), F.lit("b")), F.lit(True), marks)
    after_sources = F.when(n % 22 == 0, F.array(F.lit("c"), F.lit("a"), F.lit("d"))).when(n % 11 == 0, F.array(F.lit("a"), F.lit("b"), F.lit("c"))).otherwise(F.array(F.lit("a"), F.lit("b")))
    after = side(F.when(n % 3 == 0, (F.col("size") + 1) % 4).otherwise(F.col("size") % 4), F.when(n % 5 == 0, 1 - n % 2).otherwise(n % 2), after_sources, n % 17 != 0, F.array().cast("array<string>"))
    return L.derive(before, after)


@query("label_derivation", f"WITH {LABEL_SQL} SELECT name, strategy, confidence FROM d")
def label_derivation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return migrations(spark, sf_dir).select("name", "strategy", "confidence")


@query("thin_classes", f"""WITH {LABEL_SQL}
SELECT g.strategy AS strategy, count(d.name) AS n, count(*) FILTER (WHERE confidence = 'low') AS low_confidence, count(d.name) < 20 AS thin
FROM (VALUES ('lift_and_shift'), ('refactor'), ('redesign'), ('manual_rewrite')) g(strategy) LEFT JOIN d ON d.strategy = g.strategy GROUP BY g.strategy""")
def thin_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.summary(migrations(spark, sf_dir))
