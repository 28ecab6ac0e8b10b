"""Queries over a bundled corpus of SQL scripts: this library's own relational queries and some that exercise the reader."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.workspace import write_table
from ..operators import rubric as R
from ..operators import script_features as X
from ..operators.profile import profile
from ..registry import query
from .relational import SCRIPTS

EXTRA = {
    "flat_star": "select d_year, sum(ss_ext_sales_price) from store_sales, date_dim, item, store where ss_sold_date_sk = d_date_sk and ss_item_sk = i_item_sk and ss_store_sk = s_store_sk group by d_year",
    "two_statements": "with a as (select x_id from xs) select * from a join ys y on a.x_id = y.x_id; with a as (select x_id from xs) select count(*) from a",
    "top_n": "select top 100 [name], rank() over (partition by kind order by price desc) as r from parts",
    "not_sql": "this is ( not a query",
    "nested_sets": "(select a from t1 union all select a from t2) intersect select a from t3 except select a from t4",
    "correlated": "select o.id from orders o where o.total > (select avg(i.total) from orders i where i.customer = o.customer) and exists (select 1 from returns r where r.order_id = o.id)",
}

#: Points of a script: the features, their percentiles, and hazards that count one each.
SCORED = [("loc_code", 66, 90), ("source_tables", 66, 90), ("subquery_count", 50, 90), ("cte_count", 50, 90), ("window_function_count", 66, None), ("set_operation_count", 66, 90), ("max_nesting_depth", 66, None), ("case_expression_count", 66, 90), ("graph_edges", 66, 90), ("graph_max_degree", 90, None), ("graph_max_scope_sources", 66, 90)]
FLAT = [("correlated_subqueries", "correlated_subquery_count > 0"), ("nonportable_syntax", "size(nonportable_markers) > 0"), ("several_statements", "statements > 1"), ("cross_join_risk", "cross_join_risk > 0")]
BANDS = [("low", 0, 4), ("medium", 5, 6), ("high", 7, None)]


def corpus(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(sorted({**SCRIPTS, **EXTRA}.items()), "name string, sql string")


@query("script_features")
def script_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.extract(corpus(spark)).drop("parse_error")


@query("join_graph_shape")
def join_graph_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.extract(corpus(spark)).groupBy("widest_scope_shape").agg(F.count(F.lit(1)).alias("scripts"), F.sum("graph_edges").alias("edges"), F.sum("unresolved_predicates").alias("unresolved"))


@query("scope_depth")
def scope_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.extract(corpus(spark)).groupBy("max_nesting_depth").agg(F.count(F.lit(1)).alias("scripts"), F.sum("scope_count").alias("scopes"))


@query("dialect_cascade")
def dialect_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.extract(corpus(spark)).groupBy("parse_ok", "parse_dialect").agg(F.count(F.lit(1)).alias("scripts"))


def census(scripts: DataFrame) -> DataFrame:
    """Features with points, reasons and band by thresholds from this corpus."""
    features = write_table(X.extract(scripts).where("parse_ok"), "features")
    return R.band_for(R.score(features, R.thresholds(features, SCORED), FLAT), BANDS)


@query("corpus_census")
def corpus_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    return census(corpus(spark)).drop("parse_error")


@query("corpus_profile")
def corpus_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profile of the scored features and of the points themselves."""
    return profile(census(corpus(spark)), [x for x, _, _ in SCORED] + ["points"])


@query("resolution_coverage")
def resolution_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of join predicates that could be attributed, in percent."""
    t = X.extract(corpus(spark)).agg(F.sum("graph_edges").alias("resolved"), F.sum("unresolved_predicates").alias("unresolved"))
    total = F.col("resolved") + F.col("unresolved")
    return t.withColumn("percent", F.when(total == 0, 100.0).otherwise(100.0 * F.col("resolved") / total))
