"""Answers, grading and the decision for each script.

An answer has ``script, question, type`` (noul, choice, score), ``value_num``,
``value_str``, ``max_probability`` and ``probabilities``, an array of (label, p)
whose order carries the level.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from .rubric import BAND_ORDER, band_distance

HIGH, MEDIUM = 0.85, 0.60
VERIFIABLE = ("has_subquery", "has_window_function", "multi_source")
COMPLEXITY = "migration_complexity"


def confidence_band(confidence: Column, high: float = HIGH, medium: float = MEDIUM) -> Column:
    return F.when(confidence >= high, "high").when(confidence >= medium, "medium").otherwise("low")


def first_argmax(p: Column) -> Column:
    """0-based position of the first largest of an array of doubles."""
    return F.array_position(p, F.array_max(p)) - 1


def score_band(probabilities: Column, value: Column) -> Column:
    """Band of an ordinal answer: the most likely level, the third at most; without probabilities its value rounded half-even."""
    levels = F.transform(probabilities, lambda x: x["p"])
    place = F.when(F.size(levels) > 0, F.least(first_argmax(levels), F.lit(2).cast("long"))).otherwise(F.least(F.greatest(F.bround(value).cast("long"), F.lit(0)), F.lit(2)))
    return F.get(F.array(*[F.lit(b) for b in BAND_ORDER]), place.cast("int"))


def normalise(answers: DataFrame) -> DataFrame:
    """Answers from what a classifier returns: columns ``type``, ``choice``, ``score``, ``p_true``, ``legend`` and ``probabilities``.

    Yes/no answers become the probabilities of true and false; ordinal ones take their
    labels from the legend by position; confidence is always the largest probability.
    """
    noul = F.col("type") == "noul"
    p_true = F.coalesce(F.round(F.col("p_true").cast("double"), 6), F.lit(0.0))
    pair = F.array(F.struct(F.lit("true").alias("label"), p_true.alias("p")), F.struct(F.lit("false").alias("label"), F.round(1 - p_true, 6).alias("p")))
    named = F.transform("probabilities", lambda x, i: F.struct(F.coalesce(F.get(F.col("legend"), i), x["label"]).alias("label"), F.coalesce(F.round(x["p"], 6), F.lit(0.0)).alias("p")))
    probabilities = F.when(noul, pair).otherwise(named)
    made = answers.withColumn("probabilities", probabilities).withColumn("max_probability", F.coalesce(F.array_max(F.transform("probabilities", lambda x: x["p"])), F.lit(0.0)))
    top = F.get(F.col("probabilities"), first_argmax(F.transform("probabilities", lambda x: x["p"])).cast("int"))["label"]
    value = F.when(noul, p_true).when(F.col("type") == "score", F.coalesce(F.round(F.col("score").cast("double"), 6), F.lit(0.0)))
    return made.withColumn("value_num", value).withColumn("value_str", F.when(F.col("type") == "choice", F.col("choice"))).withColumn("label", F.when(F.col("type") == "choice", F.col("choice")).otherwise(top))


def combine_windows(answers: DataFrame) -> DataFrame:
    """One answer for each (script, question) from those of its windows (``window``): the first largest value, or the
    first most confident one for choices and ``rewrite_strategy``; n_windows is null where there was only one."""
    sure = (F.col("question") == "rewrite_strategy") | ~F.col("type").isin("noul", "score")
    rank = F.coalesce(F.when(sure, F.col("max_probability")).otherwise(F.col("value_num")), F.lit(0.0))
    columns = [c for c in answers.columns if c not in ("script", "question")]
    best = F.max_by(F.struct(*columns), F.struct(rank, -F.col("window")))
    grouped = answers.groupBy("script", "question").agg(best.alias("a"), F.count(F.lit(1)).alias("n"))
    return grouped.select("script", "question", "a.*", F.when(F.col("n") > 1, F.col("n")).alias("n_windows"))


def grade(answers: DataFrame, gold: DataFrame) -> DataFrame:
    """Outcomes: ``answers`` with ``gold`` (script, question, gold string) where there is one; without it ungradable.

    A yes/no answer is true from 1/2 on; a choice is compared as text; an ordinal one by
    its band, with the distance of bands as band_gap (99 without gold).
    """
    joined = answers.join(gold, ["script", "question"], "left")
    predicted = (
        F.when(F.col("type") == "noul", F.when(F.col("value_num") >= 0.5, "true").otherwise("false")).when(F.col("type") == "score", score_band(F.col("probabilities"), F.col("value_num"))).otherwise(F.col("value_str"))
    )
    confidence = F.coalesce("max_probability", F.lit(0.0))
    return joined.select(
        "script", "question", "gold", predicted.alias("predicted"), F.col("gold").isNotNull().alias("gradable"), F.coalesce(predicted == F.col("gold"), F.lit(False)).alias("agree"),
        confidence.alias("confidence"), confidence_band(confidence).alias("confidence_band"), F.col("question").isin(*VERIFIABLE).alias("verifiable"),
        F.when(F.col("type") == "score", band_distance(predicted, F.col("gold"))).alias("band_gap"),
    )


def decide(outcomes: DataFrame) -> DataFrame:
    """outcome and reasons for each script.

    ESCALATE if a verifiable answer is wrong with high confidence or complexity is off by
    two bands; AUTO if every gradable verifiable answer is right with high confidence and
    complexity is exact; else HUMAN_REVIEW.  Ungradable answers decide nothing.
    """
    checked = F.col("verifiable") & F.col("gradable")
    high = F.col("confidence_band") == "high"
    complexity = (F.col("question") == COMPLEXITY) & F.col("gradable")
    wrong = checked & ~F.col("agree")
    sure_wrong, far = wrong & high, complexity & (F.col("band_gap") >= 2)
    reason = (
        F.when(sure_wrong, F.concat(F.lit("confidently_wrong:"), "question"))
        .when(far, F.lit("complexity_two_bands_off"))
        .when(wrong, F.concat(F.lit("wrong:"), "question"))
        .when(checked & ~high, F.concat(F.lit("unsure:"), "question"))
        .when(complexity & ~F.col("agree"), F.lit("complexity_off"))
    )
    grouped = outcomes.groupBy("script").agg(
        F.bool_or(sure_wrong | far).alias("escalate"), F.coalesce(F.bool_and(F.when(checked, F.col("agree") & high)), F.lit(True)).alias("all_right"),
        F.coalesce(F.bool_or(complexity & F.col("agree")), F.lit(False)).alias("exact"), F.array_sort(F.collect_set(reason)).alias("reasons"),
    )
    outcome = F.when(F.col("escalate"), "ESCALATE").when(F.col("all_right") & F.col("exact"), "AUTO").otherwise("HUMAN_REVIEW")
    return grouped.select("script", outcome.alias("outcome"), "reasons")


#: What a scorer returns for a state and a question, as columns.
RAW = "question string, type string, choice string, score double, p_true double, legend array<string>, probabilities array<struct<label:string,p:double>>"


def _scored(rows: DataFrame, keys: list[str], questions: list[dict], scorer: Callable[[list[str], dict], list[dict]], size: int) -> DataFrame:
    """``keys`` and ``RAW`` for each row (``keys``, ``state``) and question.

    The scorer gets up to ``size`` states at a time, those of a batch in the order of their lengths, so that short ones
    are not padded to long ones.
    """
    import pyarrow as pa
    import pyarrow.compute as pc

    names = [*keys, *[x.split()[0] for x in RAW.split(", ")]]
    number = lambda values: pa.array([None if v is None else float(v) for v in values], pa.float64(), from_pandas=True)

    def run(batches):
        for batch in batches:
            order = pc.utf8_length(batch.column("state").fill_null("")).to_numpy().argsort(kind="stable")
            batch = batch.take(pa.array(order))
            for q in questions:
                answers = []
                states = batch.column("state")
                for at in range(0, len(states), size):
                    answers += scorer(states.slice(at, size).to_pylist(), q)
                n = len(answers)
                given = [a.get("probabilities") or [] for a in answers]
                ends = [0]
                for some in given:
                    ends.append(ends[-1] + len(some))
                pairs = pa.StructArray.from_arrays([pa.array([k for some in given for k, _ in some], pa.string()), number([v for some in given for _, v in some])], names=["label", "p"])
                columns = [
                    *[batch.column(k) for k in keys], pa.array([q["qid"]] * n, pa.string()), pa.array([q["type"]] * n, pa.string()), pa.array([a.get("choice") for a in answers], pa.string()),
                    number([a.get("score") for a in answers]), number([a.get("p_true") for a in answers]), pa.array([a.get("legend") for a in answers], pa.list_(pa.string())),
                    pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    kinds = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys)
    return rows.select(*keys, "state").mapInArrow(run, f"{kinds}, {RAW}")


ANSWER = ("question", "type", "value_num", "value_str", "label", "max_probability", "probabilities")


def ask(cards: DataFrame, questions: list[dict], scorer: Callable[[list[str], dict], list[dict]], size: int = 64) -> DataFrame:
    """Answers of a classifier to typed ``questions`` about each card (origin, state), normalised.

    ``scorer`` takes a batch of states and one question, and returns for each state what
    ``normalise`` reads: p_true, or choice with probabilities, or score with
    probabilities and a legend (probabilities as (label, p) in order).  It runs in
    tasks, ``size`` states at a time; recorded answers need no scorer.
    """
    return normalise(_scored(cards, ["origin"], questions, scorer, size)).select(F.col("origin").alias("script"), *ANSWER)


def ask_windows(scripts: DataFrame, questions: list[dict], scorer: Callable[[list[str], dict], list[dict]], budget: int = 380, size: int = 64) -> DataFrame:
    """One answer for each script (origin, sql) and question, from those of the windows of its text; ``window`` is the one that won.

    A window's state is JSON of its ``sql`` and, if there are several, a ``note`` of its place; a script without a line
    of code is one window as it is.  A null text is empty.  Windows are scored wherever they are and reduced there to the
    first best of each script and question, so those of a long script need not meet.  Scripts that repeat an origin count as one.
    """
    sql = F.coalesce("sql", F.lit(""))
    cut = text.once(text.windows(sql, budget), lambda w: F.when(F.size(w) > 0, w).otherwise(F.array(sql)))
    each = text.each_window(scripts, "origin", cut)
    state = F.to_json(F.struct("sql", text.window_note(F.col("window"), F.col("n")).alias("note")))
    answers = normalise(_scored(each.select("origin", F.col("window").cast("long").alias("window"), state.alias("state")), ["origin", "window"], questions, scorer, size))
    return combine_windows(answers.select(F.col("origin").alias("script"), "window", *ANSWER))


def match_origins(answers: DataFrame, scripts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Answers with the script they belong to, by ``origin`` (by ``id`` where an answer has none), and the stale rest."""
    keyed = answers.withColumn("_key", F.coalesce(F.col("origin"), F.col("script_id")))
    names = scripts.select(F.col("origin").alias("_key"), F.col("origin").alias("script")).union(scripts.select(F.col("id").alias("_key"), F.col("origin").alias("script"))).distinct()
    known = keyed.join(names, "_key").drop("_key")
    stale = keyed.join(names, "_key", "left_anti").select("script_id", "origin").distinct()
    return known, stale
