"""Evidence cards: the facts of a script as one line and as sentences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import join_list, plural, token_estimate

BUDGET = 380

# Keys of the fact line, in order, and the feature that each shows.
FACTS = (
    ("lines", "loc_code"),
    ("statements", "statements"),
    ("sources", "source_tables"),
    ("joins", "graph_edges"),
    ("widest_join", "graph_max_scope_sources"),
    ("subqueries", "subquery_count"),
    ("correlated", "correlated_subquery_count"),
    ("ctes", "cte_count"),
    ("window_fns", "window_function_count"),
    ("set_ops", "set_operation_count"),
    ("case_exprs", "case_expression_count"),
    ("nesting", "max_nesting_depth"),
)
PARTS = (("CTE", "cte_count"), ("subquery", "subquery_count"), ("window function", "window_function_count"), ("set operation", "set_operation_count"), ("CASE expression", "case_expression_count"))


def _n(features: DataFrame, name: str) -> Column:
    return F.coalesce(F.col(name).cast("long"), F.lit(0)) if name in features.columns else F.lit(0).cast("long")


def facts(features: DataFrame) -> Column:
    return F.concat_ws(" ", *[F.concat(F.lit(f"{k}="), _n(features, c).cast("string")) for k, c in FACTS])


def structure(features: DataFrame) -> Column:
    """Sentences on statements, sources, what is used and what is not, correlation, nesting, markers."""
    n = lambda c: _n(features, c)
    shape = F.coalesce(F.col("widest_scope_shape"), F.lit("single")) if "widest_scope_shape" in features.columns else F.lit("single")
    present = F.array_compact(F.array(*[F.when(n(c) > 0, plural(n(c), noun)) for noun, c in PARTS]))
    absent = F.array_compact(F.array(*[F.when(n(c) == 0, noun) for noun, c in PARTS]))
    marks = F.coalesce(F.col("nonportable_markers"), F.array().cast("array<string>")) if "nonportable_markers" in features.columns else F.array().cast("array<string>")
    return F.concat_ws(
        " ",
        F.concat(plural(n("statements"), "statement"), F.lit(" in the file.")),
        F.concat(F.lit("Reads "), plural(n("source_tables"), "source table"), F.lit(", joined in a "), shape, F.lit(" shape with "), plural(n("graph_edges"), "join predicate"), F.lit(".")),
        F.when(F.size(present) > 0, F.concat(F.lit("Uses "), join_list(present), F.lit("."))),
        F.when(F.size(absent) > 0, F.concat(F.lit("No "), join_list(absent, "or"), F.lit("."))),
        F.when(n("correlated_subquery_count") > 0, F.concat(plural(n("correlated_subquery_count"), "subquery"), F.lit(" correlated with the outer query."))),
        F.when(n("max_nesting_depth") > 0, F.concat(F.lit("Nests "), plural(n("max_nesting_depth"), "level"), F.lit(" deep."))),
        F.when(F.size(marks) > 0, F.concat(F.lit("Engine-specific syntax: "), F.array_join(F.slice(marks, 1, 5), ", "), F.lit("."))),
    )


def cards(features: DataFrame, purpose: Column | None = None) -> DataFrame:
    """``features`` with purpose, structure, facts, the card's token estimate and whether it is within the budget."""
    said = purpose if purpose is not None else F.lit("")
    made = features.withColumn("facts", facts(features)).withColumn("structure", structure(features)).withColumn("purpose", F.coalesce(said, F.lit("")))
    tokens = token_estimate(F.concat_ws(" ", "purpose", "structure", "facts"))
    return made.withColumn("approx_tokens", tokens).withColumn("within_budget", F.col("approx_tokens") <= BUDGET)


def state(card: DataFrame) -> DataFrame:
    """Add ``state``: what a classifier is shown, as JSON."""
    return card.withColumn("state", F.to_json(F.struct("purpose", "structure", F.col("facts").alias("metrics"))))
