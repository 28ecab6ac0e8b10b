"""Distribution profile of numeric columns with nearest-rank percentiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .order_statistics import numbers, order_statistics
from .ranking import sum_before

PERCENTILES = (25, 33, 50, 66, 75, 90, 95)


def nearest_rank(p: int, n: Column) -> Column:
    """1-based rank of percentile ``p`` among ``n`` values: half-even rounding of p/100 n + 1/2, kept in 1..n."""
    return F.greatest(F.lit(1), F.least(n, F.bround(F.lit(p / 100) * n + F.lit(0.5)).cast("long"))).cast("long")


def percentiles(values: DataFrame, key: str, value: str, ps: tuple[int, ...] = PERCENTILES) -> DataFrame:
    """p25, p33, ... of ``value`` for each ``key`` (few distinct keys), each an observed value.

    Equal values are counted before the shuffle; ranks are running sums over
    range-partitioned counts, so no task holds a whole key.
    """
    counts = values.groupBy(key, value).agg(F.count(F.lit(1)).alias("_c"))
    ranked = sum_before(counts, [key], [value], "_c", "_before")
    totals = ranked.groupBy(F.col(key).alias("_key")).agg(F.max(F.col("_before") + F.col("_c")).alias("_n"))
    # One row for each key, as above.
    ranked = ranked.join(F.broadcast(totals), F.col(key).eqNullSafe(F.col("_key")))
    at = lambda p: (F.col("_before") < nearest_rank(p, F.col("_n"))) & (nearest_rank(p, F.col("_n")) <= F.col("_before") + F.col("_c"))
    return ranked.groupBy(key).agg(*[F.max(F.when(at(p), F.col(value))).alias(f"p{p}") for p in ps])


def rank_of(p: int, n: int) -> int:
    """``nearest_rank`` of numbers."""
    return max(1, min(n, round(p / 100 * n + 0.5)))


def wide_percentiles(df: DataFrame, columns: list[str], ps: tuple[int, ...] = PERCENTILES, stored: bool = False) -> DataFrame:
    """feature, p25, p33, ... of each of ``columns`` (nulls count as 0), each an observed value; nothing of an empty table.

    ``stored`` says that ``df`` is a plain scan of files, which need not be written again.
    """
    return _percentiles_of(numbers(df, columns, stored), columns, ps)


def _percentiles_of(rows: DataFrame, columns: list[str], ps: tuple[int, ...]) -> DataFrame:
    found = order_statistics(rows, len(columns), lambda n: [rank_of(p, n) for p in ps])
    return rows.sparkSession.createDataFrame([(c, *v) for c, v in zip(columns, found)], "feature string, " + ", ".join(f"p{p} double" for p in ps))


def profile(df: DataFrame, columns: list[str], stored: bool = False) -> DataFrame:
    """feature, n, min, max, mean, stdev (sample; 0 for one row), zeros and percentiles of each of ``columns`` (nulls count as 0).

    An empty table has no rows.  A few numbers for each column come to the driver; for ``stored`` see ``wide_percentiles``.
    """
    rows = numbers(df, columns, stored)
    one = lambda f: F.array(*[f(F.col(f"c{i}")) for i in range(len(columns))])
    parts = {"n": lambda x: F.count(F.lit(1)), "min": F.min, "max": F.max, "mean": F.avg, "stdev": lambda x: F.coalesce(F.stddev_samp(x), F.lit(0.0)), "zeros": lambda x: F.count_if(x == 0)}
    wide = rows.agg(*[one(f).alias(name) for name, f in parts.items()])
    names = F.array(*[F.lit(c).alias("feature") for c in columns])
    moments = wide.select(F.explode(F.arrays_zip(names.alias("feature"), *parts)).alias("s")).select("s.*").where("n > 0")
    # One row for each column.
    return moments.join(F.broadcast(_percentiles_of(rows, columns, PERCENTILES)), "feature")
