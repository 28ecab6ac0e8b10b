"""The relational surface: each construct that the script corpora use, over the sales tables.

A query is SQL text over the tables it names; Catalyst plans it.  Channels (store,
catalog, web) are slices of ``lineitem`` by flags; returns have flag R.  Where the
oracle's dialect differs it has a text of its own.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from ..registry import query
from ..sources.tables import table

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "labels", "pages", "conversations", "benchmark", "embeddings")
_NAMES = re.compile(r"\b(" + "|".join(TABLES) + r")\b")


def run_sql(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """Run SQL over the tables that it names; they are bound as arguments, so no view outlives the call."""
    used = {n: table(spark, sf_dir, n) for n in set(_NAMES.findall(sql))}
    text = _NAMES.sub(lambda m: "{" + m[1] + "}", sql.replace("{", "{{").replace("}", "}}"))
    return spark.sql(text, **used)


#: The texts by name, which are a corpus of scripts themselves.
SCRIPTS: dict[str, str] = {}


def _add(name: str, sql: str, oracle: str | None = None, run: str | None = None) -> None:
    """``run`` is SQL of the same rows that is run in place of ``sql``."""
    SCRIPTS[name] = sql

    @query(name, oracle or sql)
    def f(spark: SparkSession, sf_dir: str) -> DataFrame:
        return run_sql(spark, sf_dir, run or sql)

    f.__name__ = name


_ORDERS_OF_1996 = "o_orderdate >= TIMESTAMP '1996-01-01 00:00:00' AND o_orderdate < TIMESTAMP '1997-01-01 00:00:00'"

_add("comma_join_star", f"""
SELECT n_name, r_name, CAST(count(*) AS BIGINT) AS orders_, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total
FROM orders, customer, nation, region
WHERE o_custkey = c_custkey AND c_nationkey = n_nationkey AND n_regionkey = r_regionkey AND {_ORDERS_OF_1996}
GROUP BY n_name, r_name""")  # fmt: skip

_add("semi_exists", """
SELECT c_custkey, c_name FROM customer c
WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 200000)""")

_add("anti_not_exists", """
SELECT c_mktsegment, CAST(count(*) AS BIGINT) AS n FROM customer c
WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey) GROUP BY c_mktsegment""")

_add("semi_theta_exists", """
SELECT CAST(count(*) AS BIGINT) AS n FROM lineitem a
WHERE EXISTS (SELECT 1 FROM lineitem b WHERE b.l_orderkey = a.l_orderkey AND b.l_suppkey <> a.l_suppkey)
  AND NOT EXISTS (SELECT 1 FROM lineitem c WHERE c.l_orderkey = a.l_orderkey AND c.l_returnflag = 'R')""")

_add("in_subquery", """
SELECT p_brand, CAST(count(*) AS BIGINT) AS n FROM part
WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45) GROUP BY p_brand""")

_add("in_value_list", """
SELECT o_orderpriority, CAST(count(*) AS BIGINT) AS n FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH', '5-LOW') AND o_orderstatus IN ('F', 'O') GROUP BY o_orderpriority""")

_add("exists_or_exists", """
SELECT s_suppkey, s_name FROM supplier s
WHERE EXISTS (SELECT 1 FROM lineitem l WHERE l.l_suppkey = s.s_suppkey AND l.l_discount > 0.09)
   OR EXISTS (SELECT 1 FROM nation n WHERE n.n_nationkey = s.s_nationkey AND n.n_regionkey = 1)""")

_add("correlated_scalar", """
SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem l
WHERE l_quantity > (SELECT 1.5 * avg(l2.l_quantity) FROM lineitem l2 WHERE l2.l_partkey = l.l_partkey)""")

_add("scalar_in_case", """
SELECT CAST(CASE WHEN (SELECT count(*) FROM lineitem WHERE l_quantity BETWEEN 1 AND 20) > 1000 THEN (SELECT round(avg(l_discount), 4) FROM lineitem WHERE l_quantity BETWEEN 1 AND 20)
       ELSE (SELECT round(avg(l_tax), 4) FROM lineitem WHERE l_quantity BETWEEN 1 AND 20) END AS DOUBLE) AS bucket1,
       CAST(CASE WHEN (SELECT count(*) FROM lineitem WHERE l_quantity BETWEEN 21 AND 40) > 1000000 THEN (SELECT round(avg(l_discount), 4) FROM lineitem WHERE l_quantity BETWEEN 21 AND 40)
       ELSE (SELECT round(avg(l_tax), 4) FROM lineitem WHERE l_quantity BETWEEN 21 AND 40) END AS DOUBLE) AS bucket2
FROM region WHERE r_regionkey = 1""")

_add("left_outer_is_null", """
SELECT o_orderkey, o_custkey FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey AND l_returnflag = 'R' WHERE l_orderkey IS NULL""")

_add("full_outer_case", """
SELECT CAST(sum(CASE WHEN r.k IS NOT NULL AND n.k IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS returned_only,
       CAST(sum(CASE WHEN r.k IS NULL AND n.k IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS other_only,
       CAST(sum(CASE WHEN r.k IS NOT NULL AND n.k IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS both_
FROM (SELECT l_partkey AS k FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 40 GROUP BY l_partkey) r
FULL OUTER JOIN (SELECT l_partkey AS k FROM lineitem WHERE l_returnflag = 'N' AND l_quantity > 40 GROUP BY l_partkey) n ON r.k = n.k""")

_add("cross_single_rows", """
SELECT a.n AS small, b.n AS middle, c.n AS large, round(a.p, 4) AS small_price, round(c.p, 4) AS large_price FROM
  (SELECT CAST(count(DISTINCT l_partkey) AS BIGINT) AS n, avg(l_discount) AS p FROM lineitem WHERE l_quantity < 10) a,
  (SELECT CAST(count(DISTINCT l_partkey) AS BIGINT) AS n, avg(l_discount) AS p FROM lineitem WHERE l_quantity BETWEEN 10 AND 30) b,
  (SELECT CAST(count(DISTINCT l_partkey) AS BIGINT) AS n, avg(l_discount) AS p FROM lineitem WHERE l_quantity > 30) c""")

_add("theta_self_join", """
WITH multi AS (SELECT DISTINCT a.l_orderkey AS k FROM lineitem a, lineitem b WHERE a.l_orderkey = b.l_orderkey AND a.l_suppkey <> b.l_suppkey)
SELECT o_orderstatus, CAST(count(*) AS BIGINT) AS n FROM orders WHERE o_orderkey IN (SELECT k FROM multi) GROUP BY o_orderstatus""")

_add("range_residual_join", """
SELECT CAST(count(*) AS BIGINT) AS n, CAST(min(l_orderkey) AS BIGINT) AS first_ FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
WHERE l_quantity < p_size AND l_shipdate > o_orderdate + INTERVAL '60' DAY""")

_add("union_all_channels", """
SELECT channel, p_brand, CAST(sum(cents) AS BIGINT) AS cents FROM (
  SELECT 'store' AS channel, l_partkey AS k, CAST(round(l_extendedprice * 100) AS BIGINT) AS cents FROM lineitem WHERE l_linestatus = 'O'
  UNION ALL SELECT 'web', l_partkey, CAST(round(l_extendedprice * 100) AS BIGINT) FROM lineitem WHERE l_linestatus = 'F' AND l_returnflag <> 'R'
  UNION ALL SELECT 'returns', l_partkey, -CAST(round(l_extendedprice * 100) AS BIGINT) FROM lineitem WHERE l_returnflag = 'R') x
JOIN part ON k = p_partkey GROUP BY channel, p_brand""")

_add("union_distinct", """
SELECT l_suppkey AS k, l_returnflag AS flag FROM lineitem WHERE l_quantity > 48 UNION SELECT l_suppkey, l_returnflag FROM lineitem WHERE l_discount > 0.09""")

_add("intersect_3", """
SELECT CAST(count(*) AS BIGINT) AS n FROM (
  SELECT DISTINCT l_partkey FROM lineitem WHERE l_returnflag = 'R' INTERSECT SELECT DISTINCT l_partkey FROM lineitem WHERE l_returnflag = 'N' INTERSECT SELECT DISTINCT l_partkey FROM lineitem WHERE l_returnflag = 'A') x""")

_add("except_chain", """
SELECT CAST(count(*) AS BIGINT) AS n FROM ((SELECT DISTINCT c_custkey FROM customer) EXCEPT (SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'F') EXCEPT (SELECT DISTINCT o_custkey FROM orders WHERE o_totalprice > 300000)) x""")

_add("rollup_grouping", """
SELECT r_name, n_name, CAST(grouping(r_name) + grouping(n_name) AS BIGINT) AS level_, CAST(count(*) AS BIGINT) AS n, CAST(sum(CAST(c_acctbal AS DECIMAL(18,2))) AS DOUBLE) AS balance
FROM customer, nation, region WHERE c_nationkey = n_nationkey AND n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)""")

_add("rank_in_rollup", """
SELECT r_name, n_name, level_, n, CAST(rank() OVER (PARTITION BY level_, CASE WHEN level_ = 0 THEN r_name END ORDER BY n DESC) AS BIGINT) AS place FROM (
  SELECT r_name, n_name, CAST(grouping(r_name) + grouping(n_name) AS BIGINT) AS level_, CAST(count(*) AS BIGINT) AS n
  FROM customer, nation, region WHERE c_nationkey = n_nationkey AND n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)) x""")

_add("rank_topk_per_group", """
SELECT p_brand, p_partkey, cents, place FROM (
  SELECT p_brand, p_partkey, cents, CAST(rank() OVER (PARTITION BY p_brand ORDER BY cents DESC) AS BIGINT) AS place FROM (
    SELECT p_brand, p_partkey, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS cents FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand, p_partkey) s) r
WHERE place <= 5""")

_add("running_sum_rows", """
SELECT month_, priority, CAST(sum(n) OVER (PARTITION BY priority ORDER BY month_ ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS running FROM (
  SELECT CAST(year(o_orderdate) * 12 + month(o_orderdate) AS BIGINT) AS month_, o_orderpriority AS priority, count(*) AS n FROM orders GROUP BY 1, 2) m""")

_add("sum_over_sum", """
SELECT p_type, p_brand, cents, round(CAST(cents AS DOUBLE) * 100 / CAST(sum(cents) OVER (PARTITION BY p_type) AS DOUBLE), 4) AS percent FROM (
  SELECT p_type, p_brand, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS cents FROM lineitem, part WHERE l_partkey = p_partkey GROUP BY p_type, p_brand) s""")

_add("avg_of_sum_over", """
SELECT * FROM (
  SELECT y, seg, n, round(avg(n) OVER (PARTITION BY seg), 4) AS mean_ FROM (
    SELECT CAST(year(o_orderdate) AS BIGINT) AS y, c_mktsegment AS seg, CAST(count(*) AS BIGINT) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2) a) b
WHERE CASE WHEN mean_ > 0 THEN abs(n - mean_) / mean_ ELSE 0 END > 0.05""")

_add("self_join_lag", """
WITH v AS (SELECT c_mktsegment AS seg, CAST(year(o_orderdate) AS BIGINT) AS y, CAST(month(o_orderdate) AS BIGINT) AS m, count(*) AS n,
             rank() OVER (PARTITION BY c_mktsegment ORDER BY year(o_orderdate), month(o_orderdate)) AS rn
           FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment, year(o_orderdate), month(o_orderdate))
SELECT a.seg AS seg, a.y AS y, a.m AS m, CAST(b.n AS BIGINT) AS before_, CAST(a.n AS BIGINT) AS n, CAST(c.n AS BIGINT) AS after_
FROM v a, v b, v c WHERE a.seg = b.seg AND a.seg = c.seg AND a.rn = b.rn + 1 AND a.rn = c.rn - 1""")

_add("having_scalar", """
SELECT l_partkey, CAST(count(*) AS BIGINT) AS n FROM lineitem GROUP BY l_partkey HAVING count(*) > 1.2 * (SELECT count(*) * 1.0 / count(DISTINCT l_partkey) FROM lineitem)""")

_add("count_distinct_multi", """
SELECT o_orderstatus, CAST(count(DISTINCT o_custkey) AS BIGINT) AS customers, CAST(count(DISTINCT o_orderpriority) AS BIGINT) AS priorities, CAST(count(o_orderkey) AS BIGINT) AS orders_ FROM orders GROUP BY o_orderstatus""")

_add("conditional_pivot", """
SELECT o_orderpriority,
       CAST(sum(CASE WHEN month(o_orderdate) BETWEEN 1 AND 3 THEN 1 ELSE 0 END) AS BIGINT) AS q1, CAST(sum(CASE WHEN month(o_orderdate) BETWEEN 4 AND 6 THEN 1 ELSE 0 END) AS BIGINT) AS q2,
       CAST(sum(CASE WHEN month(o_orderdate) BETWEEN 7 AND 9 THEN 1 ELSE 0 END) AS BIGINT) AS q3, CAST(sum(CASE WHEN month(o_orderdate) > 9 THEN 1 ELSE 0 END) AS BIGINT) AS q4
FROM orders GROUP BY o_orderpriority""")

_add("simple_case", """
SELECT CASE o_orderstatus WHEN 'F' THEN 'finished' WHEN 'O' THEN 'open' ELSE 'mixed' END AS state, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY 1""")

_add("date_interval_between", """
SELECT CAST(o_orderdate AS DATE) AS day, CAST(count(*) AS BIGINT) AS n FROM orders
WHERE CAST(o_orderdate AS DATE) BETWEEN CAST('1995-03-01' AS DATE) AND (CAST('1995-03-01' AS DATE) + INTERVAL '60' DAY) GROUP BY 1""")

_add("substr_join", """
SELECT substr(c.c_name, length(c.c_name) - 1, 2) AS tail, CAST(count(*) AS BIGINT) AS n FROM customer c JOIN supplier s ON substr(c.c_name, length(c.c_name) - 1, 2) = substr(s.s_name, length(s.s_name) - 1, 2) GROUP BY 1""",
# Tails are few, so the pairs grow with the square of the tables: each side is counted by itself.
run="""
SELECT c.tail AS tail, c.n * s.n AS n FROM
  (SELECT substr(c_name, length(c_name) - 1, 2) AS tail, CAST(count(*) AS BIGINT) AS n FROM customer GROUP BY 1) c JOIN
  (SELECT substr(s_name, length(s_name) - 1, 2) AS tail, CAST(count(*) AS BIGINT) AS n FROM supplier GROUP BY 1) s ON c.tail = s.tail""")

_add("stddev_cov", """
SELECT l_returnflag, l_linestatus, round(stddev_samp(l_quantity), 4) AS dev, round(stddev_samp(l_quantity) / avg(l_quantity), 6) AS cov FROM lineitem GROUP BY l_returnflag, l_linestatus""")

_add("disjunctive_filter", """
SELECT CAST(count(*) AS BIGINT) AS n, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS quantity FROM lineitem, part
WHERE (p_partkey = l_partkey AND p_size BETWEEN 1 AND 10 AND l_quantity BETWEEN 1 AND 15)
   OR (p_partkey = l_partkey AND p_size BETWEEN 11 AND 30 AND l_quantity BETWEEN 10 AND 30)
   OR (p_partkey = l_partkey AND p_size > 30 AND l_quantity > 25)""")

_add("coalesce_union", """
SELECT coalesce(a.k, b.k) AS k, CAST(coalesce(a.n, 0) AS BIGINT) AS sold, CAST(coalesce(b.n, 0) AS BIGINT) AS returned, CAST(coalesce(a.n, 0) - coalesce(b.n, 0) AS BIGINT) AS net FROM
  (SELECT l_suppkey AS k, count(*) AS n FROM lineitem WHERE l_returnflag <> 'R' GROUP BY l_suppkey) a LEFT JOIN
  (SELECT l_suppkey AS k, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_suppkey) b ON a.k = b.k""")

_add("sort_limit_topk", """
SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100""")

_add("like_upper_concat", """
SELECT upper(p_type) AS kind, p_brand || '/' || CAST(p_size AS VARCHAR(10)) AS label, CAST(count(*) AS BIGINT) AS n FROM part WHERE p_name LIKE '%a%' AND NOT (p_size = 1 OR p_size IS NULL) GROUP BY 1, 2""")

_add("ratio_decimal_cast", """
SELECT round(CAST(CAST(a.n AS DECIMAL(15,4)) AS DOUBLE) / CAST(CAST(b.n AS DECIMAL(15,4)) AS DOUBLE), 6) AS ratio FROM
  (SELECT count(*) AS n FROM orders WHERE month(o_orderdate) <= 6) a, (SELECT count(*) AS n FROM orders) b""")

_add("year_over_year", """
WITH y AS (SELECT o_custkey AS k, CAST(year(o_orderdate) AS BIGINT) AS y, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total FROM orders GROUP BY 1, 2)
SELECT a.k AS k, a.total AS first_, b.total AS second_ FROM y a, y b WHERE a.k = b.k AND a.y = 1995 AND b.y = 1996 AND CASE WHEN a.total > 0 THEN b.total / a.total END > 1.5""")

_add("case_buckets_dates", """
SELECT s_nationkey, CAST(sum(CASE WHEN d <= 30 THEN 1 ELSE 0 END) AS BIGINT) AS d30, CAST(sum(CASE WHEN d > 30 AND d <= 60 THEN 1 ELSE 0 END) AS BIGINT) AS d60, CAST(sum(CASE WHEN d > 60 THEN 1 ELSE 0 END) AS BIGINT) AS more_
FROM (SELECT s_nationkey, datediff(CAST(l_shipdate AS DATE), CAST(o_orderdate AS DATE)) AS d FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey) x GROUP BY s_nationkey""",
"""
SELECT s_nationkey, CAST(sum(CASE WHEN d <= 30 THEN 1 ELSE 0 END) AS BIGINT) AS d30, CAST(sum(CASE WHEN d > 30 AND d <= 60 THEN 1 ELSE 0 END) AS BIGINT) AS d60, CAST(sum(CASE WHEN d > 60 THEN 1 ELSE 0 END) AS BIGINT) AS more_
FROM (SELECT s_nationkey, date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) AS d FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey) x GROUP BY s_nationkey""")

_add("cte_reused", """
WITH s AS (SELECT l_suppkey AS k, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS cents FROM lineitem GROUP BY l_suppkey)
SELECT k, s_name, cents FROM s, supplier WHERE k = s_suppkey AND cents >= (SELECT 0.9 * max(cents) FROM s)""")
