"""Queries on scripts that Spark reads only once they are said its way: quoted names, TOP, several statements."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.statements import spark_form, statements
from ..registry import query
from .relational import run_sql


def run_script(spark: SparkSession, sf_dir: str, script: str) -> list[DataFrame]:
    """The result of each statement of a script over the tables that it names."""
    return [run_sql(spark, sf_dir, spark_form(s)) for s in statements(script)]


@query("quoted_alias", """SELECT n_name AS "land; name", count(*) AS "30 days" FROM customer, nation WHERE c_nationkey = n_nationkey AND c_acctbal > 0 GROUP BY n_name""")
def quoted_alias(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names in backticks and in double quotes, with spaces and a semicolon."""
    return run_script(spark, sf_dir, """select n_name as "land; name", count(*) as `30 days` from customer, nation where c_nationkey = n_nationkey and c_acctbal > 0 group by n_name;""")[0]


@query("select_top", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey ORDER BY n DESC, o_custkey LIMIT 100")
def select_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_script(spark, sf_dir, "-- the busiest\nselect top 100 o_custkey, count(*) as n from orders group by o_custkey order by count(*) desc, o_custkey")[0]


@query("two_statements", "SELECT 1 AS statement, count(*) AS n FROM customer WHERE c_acctbal < 0 UNION ALL SELECT 2, count(*) FROM (SELECT s_suppkey FROM supplier ORDER BY s_acctbal, s_suppkey LIMIT 7)")
def two_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    script = "select count(*) as n from customer where c_acctbal < 0; -- ;\nselect top 7 s_suppkey from supplier order by s_acctbal, s_suppkey;\n"
    first, second = run_script(spark, sf_dir, script)
    both = [first, second.agg(F.count(F.lit(1)).alias("n"))]
    return reduce(DataFrame.union, [d.select(F.lit(i).alias("statement"), "n") for i, d in enumerate(both, 1)])
