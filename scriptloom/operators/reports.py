"""The tables that a report on a corpus or a run shows; each is a plan of its own."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import decisions as D
from . import metrics as M
from . import rubric as R
from .profile import profile


def census_tables(census: DataFrame, columns: list[str]) -> dict[str, DataFrame]:
    """profile, dialects, bands, shapes, markers, histogram of points, highest and lowest scores, resolved join predicates."""
    edges, open_ = F.sum("graph_edges"), F.sum("unresolved_predicates")
    return {
        "profile": profile(census, [*columns, "points"]),
        "dialects": R.distribution(census, "parse_dialect"),
        "bands": R.distribution(census, "band"),
        "shapes": R.distribution(census, "widest_scope_shape"),
        "markers": R.distribution(census.select(F.explode("nonportable_markers").alias("marker")), "marker"),
        "histogram": R.histogram(census, "points", 8),
        "extremes": R.extremes(census, "name", "points", 12, 8),
        "coverage": census.agg(edges.alias("resolved"), open_.alias("unresolved"), F.coalesce(F.try_divide(100.0 * edges, edges + open_), F.lit(100.0)).alias("percent")),
    }


def run_tables(outcomes: DataFrame, questions: list[str]) -> dict[str, DataFrame]:
    """Decisions, outcome counts, questions, calibration, coverage and confusion of a graded run."""
    decided = D.decide(outcomes)
    return {
        "decisions": decided,
        "outcomes": R.distribution(decided, "outcome"),
        "questions": M.per_question(outcomes),
        "accuracy": M.accuracy(outcomes, ["question"]),
        "reliability": M.reliability(outcomes),
        "calibration": M.calibration_error(outcomes),
        "brier": M.brier(outcomes, ["question"]),
        "coverage": M.coverage_curve(outcomes),
        "script_coverage": M.script_coverage(outcomes, questions),
        "confusion": M.confusion(outcomes.where(F.col("question") == D.COMPLEXITY), list(R.BAND_ORDER)),
    }
