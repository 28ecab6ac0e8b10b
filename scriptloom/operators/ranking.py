"""Running sums and gapless numbers within keys, without one task per key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.workspace import shuffle_partitions, write_table


def sums_before(df: DataFrame, keys: list[str], order: list[str], sums: dict[str, str | None], largest: dict[str, Column] | None = None) -> DataFrame:
    """Add a column for each of ``sums``: the sum of its weight (a long column; None: 1 a row) over the rows before this
    one among those that agree in ``keys``, in ``order``; nulls come first, ties in any order.  ``largest``
    adds the largest value of a column over the rows up to this one, from what the sums are.

    Rows are range-partitioned by keys and order together, so a key that holds most
    rows spreads over many tasks.  Each task sums its own rows; what lies before it
    comes from a table of at most tasks + distinct keys rows.  The number of distinct
    keys must be bounded, as that table is joined by broadcast.
    """
    by: list[Column] = [F.col(c) for c in [*keys, *order]]
    dealt = df.repartitionByRange(shuffle_partitions(df.sparkSession), *by)
    rows = write_table(dealt.withColumn("_task", F.spark_partition_id()), "ranked")
    weights = {name: F.col(w).cast("long") if w else F.lit(1).cast("long") for name, w in sums.items()}
    totals = rows.groupBy(*keys, "_task").agg(*[F.sum(w).alias(f"_sum_{name}") for name, w in weights.items()])
    earlier = Window.partitionBy(*keys).orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    of_task = [*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_task").alias("_t")]
    offsets = totals.select(*of_task, *[F.coalesce(F.sum(f"_sum_{name}").over(earlier), F.lit(0)).alias(f"_offset_{name}") for name in sums])
    within = Window.partitionBy("_task", *keys).orderBy(*order)
    before = within.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.select("*", *[F.coalesce(F.sum(w).over(before), F.lit(0)).alias(f"_within_{name}") for name, w in weights.items()])
    on = F.col("_task") == F.col("_t")
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    found = rows.join(F.broadcast(offsets), on).select(*df.columns, "_task", *[(F.col(f"_within_{name}") + F.col(f"_offset_{name}")).alias(name) for name in sums])
    for name, value in (largest or {}).items():
        so_far = found.withColumn("_value", value).withColumn("_here", F.max("_value").over(within))
        tops = so_far.groupBy(*keys, "_task").agg(F.max("_value").alias("_top"))
        tops = tops.select(*of_task, F.max("_top").over(earlier).alias("_earlier"))
        found = so_far.join(F.broadcast(tops), on).withColumn(name, F.greatest("_here", "_earlier")).drop("_value", "_here", "_earlier", "_t", *[f"_k{i}" for i in range(len(keys))])
    return found.drop("_task")


def sum_before(df: DataFrame, keys: list[str], order: list[str], weight: str | None, name: str) -> DataFrame:
    """Add one sum, ``name``; see ``sums_before``."""
    return sums_before(df, keys, order, {name: weight})


def number_within(df: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """Add ``name``: 0, 1, 2, ... among the rows that agree in ``keys``; see ``sum_before``."""
    return sum_before(df, keys, order, None, name)
