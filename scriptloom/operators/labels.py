"""Labels of finished migrations from structural differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The counts that make up a script's shape, and the strategies.
SHAPE = ("subquery_count", "correlated_subquery_count", "derived_table_count", "cte_count", "window_function_count", "set_operation_count", "max_nesting_depth", "statements")
STRATEGIES = ("lift_and_shift", "refactor", "redesign", "manual_rewrite")
THIN = 20


def derive(before: DataFrame, after: DataFrame, name: str = "name") -> DataFrame:
    """name, strategy, confidence, reasons, shape_changes, sources added and removed of scripts that both sides have.

    Both have ``distinct_sources``, ``parse_ok``, ``parse_dialect``, ``nonportable_markers``
    and the counts of ``SHAPE`` (missing counts are 0).
    """
    columns = [*SHAPE, "distinct_sources", "parse_ok", "parse_dialect", "nonportable_markers"]
    pick = lambda df, p: df.select(name, *[(F.col(c) if c in df.columns else F.lit(None)).alias(f"{p}{c}") for c in columns])
    pair = pick(before, "b_").join(pick(after, "a_"), name)
    empty = F.array().cast("array<string>")
    arr = lambda c: F.coalesce(F.col(c), empty)
    n = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(0))
    added = F.array_sort(F.array_except(arr("a_distinct_sources"), arr("b_distinct_sources")))
    removed = F.array_sort(F.array_except(arr("b_distinct_sources"), arr("a_distinct_sources")))
    changes = F.array_compact(F.array(*[F.when(n(f"b_{c}") != n(f"a_{c}"), F.struct(F.lit(c).alias("feature"), n(f"b_{c}").alias("before"), n(f"a_{c}").alias("after"))) for c in sorted(SHAPE)]))
    moved = F.array_sort(F.array_union(F.array_except(arr("a_nonportable_markers"), arr("b_nonportable_markers")), F.array_except(arr("b_nonportable_markers"), arr("a_nonportable_markers"))))
    parsed = F.coalesce(F.col("b_parse_ok") & F.col("a_parse_ok"), F.lit(False))
    made = pair.select(
        name, parsed.alias("parse_ok"), F.when(parsed, added).otherwise(empty).alias("sources_added"), F.when(parsed, removed).otherwise(empty).alias("sources_removed"),
        F.when(parsed, changes).otherwise(F.array().cast("array<struct<feature:string,before:bigint,after:bigint>>")).alias("shape_changes"),
        moved.alias("_moved"), (~F.col("b_parse_dialect").eqNullSafe(F.col("a_parse_dialect"))).alias("_dialect"), F.size(arr("b_distinct_sources")).alias("_sources"),
    )
    churn, shape = F.size("sources_added") + F.size("sources_removed"), F.size("shape_changes")
    other = (F.size("_moved") > 0) | F.col("_dialect")
    strategy = (
        F.when(~F.col("parse_ok"), "manual_rewrite").when(churn > F.col("_sources"), "manual_rewrite").when(churn > 0, "redesign").when(shape >= 4, "redesign").when(shape > 0, "refactor").otherwise("lift_and_shift")
    )
    confidence = (
        F.when(~F.col("parse_ok"), "low").when(churn > 1, "high").when(churn > 0, "medium").when(shape >= 2, "high").when(shape > 0, "medium").when(other, "high").otherwise("medium")
    )
    listed: Column = F.when(~F.col("parse_ok"), F.array(F.lit("not_parsed")))
    listed = listed.when(
        churn > 0,
        F.array_compact(F.array(F.when(F.size("sources_added") > 0, F.concat(F.lit("reads:"), F.array_join("sources_added", ","))), F.when(F.size("sources_removed") > 0, F.concat(F.lit("no_longer_reads:"), F.array_join("sources_removed", ","))))),
    )
    listed = listed.when(shape > 0, F.transform("shape_changes", lambda x: F.concat(x["feature"], F.lit(":"), x["before"].cast("string"), F.lit("->"), x["after"].cast("string"))))
    listed = listed.otherwise(
        F.coalesce(F.nullif(F.array_compact(F.array(F.when(F.col("_dialect"), F.lit("dialect_changed")), F.when(F.size("_moved") > 0, F.concat(F.lit("markers:"), F.array_join(F.slice("_moved", 1, 4), ","))))), empty), F.array(F.lit("no_difference")))
    )
    return made.select(name, strategy.alias("strategy"), confidence.alias("confidence"), listed.alias("reasons"), "shape_changes", "sources_added", "sources_removed", "parse_ok")


def summary(derived: DataFrame) -> DataFrame:
    """strategy, n, low_confidence, thin (under 20 examples) for each strategy, those without examples included."""
    counts = derived.groupBy("strategy").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("confidence") == "low").alias("low_confidence"))
    grid = derived.sparkSession.createDataFrame([(s,) for s in STRATEGIES], "strategy string")
    return grid.join(counts, "strategy", "left").na.fill(0).withColumn("thin", F.col("n") < THIN)
