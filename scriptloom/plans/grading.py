"""Queries on answers, windows and decisions: conversations and events stand for scripts and their answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import decisions as D
from ..registry import query
from ..sources.tables import table
from .texts import WINDOWS_SQL, scripts

#: Each user is a script; each event is an answer of one window to one of four questions.
ANSWERS_SQL = """
a AS (SELECT user_id AS script, CASE event_id % 4 WHEN 0 THEN 'has_subquery' WHEN 1 THEN 'has_window_function' WHEN 2 THEN 'multi_source' ELSE 'migration_complexity' END AS question,
             event_id AS window_, CASE WHEN event_id % 4 = 3 THEN 'score' ELSE 'noul' END AS type, ((event_id * 37) % 101) / 100.0::DOUBLE AS p FROM events)
"""


def window_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "user_id")
    names = F.array(*[F.lit(q) for q in (*D.VERIFIABLE, D.COMPLEXITY)])
    p = (F.col("event_id") * 37 % 101) / F.lit(100.0)
    ordinal = F.col("event_id") % 4 == 3
    level = lambda x, q: F.struct(F.lit(x).alias("label"), q.alias("p"))
    three = F.array(level("low", F.round(1 - p, 2)), level("medium", F.round(p * 0.7, 3)), level("high", F.round(p * 0.9, 3)))
    two = F.array(level("true", p), level("false", F.round(1 - p, 2)))
    made = e.select(
        F.col("user_id").alias("script"), F.get(names, (F.col("event_id") % 4).cast("int")).alias("question"), F.col("event_id").alias("window"),
        F.when(ordinal, "score").otherwise("noul").alias("type"), p.alias("value_num"), F.lit(None).cast("string").alias("value_str"), F.when(ordinal, three).otherwise(two).alias("probabilities"),
    )
    return made.withColumn("max_probability", F.array_max(F.transform("probabilities", lambda x: x["p"])))


_COMBINED = f"""{ANSWERS_SQL},
w AS (SELECT script, question, type, p, window_, count(*) OVER (PARTITION BY script, question) AS n, row_number() OVER (PARTITION BY script, question ORDER BY p DESC, window_) AS r FROM a),
b AS (SELECT script, question, type, p, window_, CASE WHEN n > 1 THEN n END AS n_windows,
             CASE WHEN type = 'noul' THEN greatest(p, round(1 - p, 2)) ELSE greatest(round(1 - p, 2), round(p * 0.7, 3), round(p * 0.9, 3)) END AS confidence FROM w WHERE r = 1)"""


@query("window_aggregate", f"WITH {_COMBINED} SELECT script, question, p AS value_num, window_, n_windows, round(confidence, 6) AS max_probability FROM b")
def window_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = D.combine_windows(window_answers(spark, sf_dir))
    return found.select("script", "question", "value_num", F.col("window").alias("window_"), "n_windows", F.round("max_probability", 6).alias("max_probability"))


ASKED = [{"qid": "has_subquery", "type": "noul"}, {"qid": "migration_complexity", "type": "score"}, {"qid": "rewrite_strategy", "type": "choice"}]


def by_length(states: list[str], question: dict) -> list[dict]:
    """Stands for a classifier: answers by the characters of a window."""
    import json

    turn = [q["qid"] for q in ASKED].index(question["qid"])
    out = []
    for state in states:
        p = (len(json.loads(state)["sql"]) * 37 + turn * 11) % 101 / 100
        levels = [("low", round(1 - p, 2)), ("medium", round(p * 0.7, 3)), ("high", round(p * 0.9, 3))]
        ways = [("refactor", round(1 - p, 2)), ("redesign", p)]
        out.append({"noul": {"p_true": p}, "score": {"score": 2 * p, "probabilities": levels}, "choice": {"choice": "redesign" if p > 0.5 else "refactor", "probabilities": ways}}[question["type"]])
    return out


@query("ask_windows", f"""WITH RECURSIVE {WINDOWS_SQL},
q AS (SELECT unnest(['has_subquery', 'migration_complexity', 'rewrite_strategy']) AS question, unnest(['noul', 'score', 'choice']) AS type, unnest([0, 1, 2]) AS turn),
a AS (SELECT doc_id AS script, win AS window_, question, type, ((length(txt) * 37 + turn * 11) % 101) / 100.0::DOUBLE AS p FROM g, q),
v AS (SELECT *, CASE type WHEN 'noul' THEN p WHEN 'score' THEN round(2 * p, 6) END AS value_num, CASE WHEN type = 'choice' THEN CASE WHEN p > 0.5 THEN 'redesign' ELSE 'refactor' END END AS value_str,
        CASE type WHEN 'score' THEN greatest(round(1 - p, 2), round(p * 0.7, 3), round(p * 0.9, 3)) ELSE greatest(p, round(1 - p, 2)) END AS max_probability FROM a),
r AS (SELECT *, count(*) OVER (PARTITION BY script, question) AS n, row_number() OVER (PARTITION BY script, question ORDER BY CASE WHEN type = 'choice' THEN max_probability ELSE value_num END DESC, window_) AS k FROM v)
SELECT script, question, type, round(value_num, 6) AS value_num, value_str, CASE type WHEN 'noul' THEN CASE WHEN p >= round(1 - p, 2) THEN 'true' ELSE 'false' END WHEN 'choice' THEN value_str
  ELSE CASE WHEN round(1 - p, 2) >= round(p * 0.9, 3) THEN 'low' ELSE 'high' END END AS label, round(max_probability, 6) AS max_probability, window_, CASE WHEN n > 1 THEN n END AS n_windows FROM r WHERE k = 1""")
def ask_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as scripts, asked three kinds of questions window by window."""
    found = D.ask_windows(scripts(spark, sf_dir).withColumnRenamed("doc_id", "origin"), ASKED, by_length)
    return found.select("script", "question", "type", F.round("value_num", 6).alias("value_num"), "value_str", "label", F.round("max_probability", 6).alias("max_probability"), F.col("window").alias("window_"), "n_windows")


GOLD_SQL = """
g AS (SELECT c_custkey AS script, q.question AS question,
        CASE q.question WHEN 'has_subquery' THEN CASE WHEN c_nationkey % 2 = 0 THEN 'true' ELSE 'false' END WHEN 'has_window_function' THEN CASE WHEN c_nationkey < 20 THEN 'true' ELSE 'false' END
          WHEN 'multi_source' THEN CASE WHEN c_nationkey < 5 THEN NULL WHEN c_acctbal > 0 THEN 'true' ELSE 'false' END
          ELSE CASE WHEN c_acctbal < 2000 THEN 'low' WHEN c_acctbal < 6000 THEN 'medium' ELSE 'high' END END AS gold
      FROM customer, (VALUES ('has_subquery'), ('has_window_function'), ('multi_source'), ('migration_complexity')) q(question))
"""


def gold_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    yes = lambda cond: F.when(cond, "true").otherwise("false")
    n, x = F.col("c_nationkey"), F.col("c_acctbal")
    complexity = F.when(x < 2000, "low").when(x < 6000, "medium").otherwise("high")
    values = (yes(n % 2 == 0), yes(n < 20), F.when(n >= 5, yes(x > 0)), complexity)
    pairs = F.array(*[F.struct(F.lit(q).alias("question"), v.alias("gold")) for q, v in zip((*D.VERIFIABLE, D.COMPLEXITY), values)])
    return c.select(F.col("c_custkey").alias("script"), F.explode(pairs).alias("x")).select("script", "x.question", "x.gold")


_BAND3 = "CASE WHEN round(1 - p, 2) >= round(p * 0.7, 3) AND round(1 - p, 2) >= round(p * 0.9, 3) THEN 'low' WHEN round(p * 0.7, 3) >= round(p * 0.9, 3) THEN 'medium' ELSE 'high' END"
_GRADED = f"""{_COMBINED}, {GOLD_SQL},
o AS (SELECT b.script AS script, b.question AS question, g.gold AS gold, confidence, CASE WHEN type = 'noul' THEN CASE WHEN p >= 0.5 THEN 'true' ELSE 'false' END ELSE {_BAND3} END AS predicted, type
      FROM b LEFT JOIN g ON g.script = b.script AND g.question = b.question),
x AS (SELECT *, gold IS NOT NULL AS gradable, coalesce(predicted = gold, FALSE) AS agree, CASE WHEN confidence >= 0.85 THEN 'high' WHEN confidence >= 0.6 THEN 'medium' ELSE 'low' END AS confidence_band,
        CASE WHEN type = 'score' THEN CAST(coalesce(abs(list_position(['low', 'medium', 'high'], predicted) - list_position(['low', 'medium', 'high'], gold)), 99) AS BIGINT) END AS band_gap FROM o)"""


def graded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.grade(D.combine_windows(window_answers(spark, sf_dir)), gold_labels(spark, sf_dir))


@query("grade_answers", f"WITH {_GRADED} SELECT script, question, gold, predicted, gradable, agree, confidence_band, band_gap FROM x")
def grade_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graded(spark, sf_dir).select("script", "question", "gold", "predicted", "gradable", "agree", "confidence_band", "band_gap")


@query("confidence_bands", f"WITH {_GRADED} SELECT question, confidence_band, count(*) AS n, count(*) FILTER (WHERE agree) AS right_ FROM x GROUP BY 1, 2")
def confidence_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graded(spark, sf_dir).groupBy("question", "confidence_band").agg(F.count(F.lit(1)).alias("n"), F.count_if("agree").alias("right_"))


_DECIDED = f"""{_GRADED},
v AS (SELECT *, question <> 'migration_complexity' AND gradable AS checked, question = 'migration_complexity' AND gradable AS cx FROM x),
d AS (SELECT script, bool_or((checked AND NOT agree AND confidence_band = 'high') OR (cx AND band_gap >= 2)) AS esc, coalesce(bool_and(CASE WHEN checked THEN agree AND confidence_band = 'high' END), TRUE) AS ok,
        coalesce(bool_or(cx AND agree), FALSE) AS exact_,
        list_sort(list_distinct(list_filter(list(CASE WHEN checked AND NOT agree AND confidence_band = 'high' THEN 'confidently_wrong:' || question WHEN cx AND band_gap >= 2 THEN 'complexity_two_bands_off'
          WHEN checked AND NOT agree THEN 'wrong:' || question WHEN checked AND confidence_band <> 'high' THEN 'unsure:' || question WHEN cx AND NOT agree THEN 'complexity_off' END), lambda r: r IS NOT NULL))) AS reasons
      FROM v GROUP BY script),
e AS (SELECT script, CASE WHEN esc THEN 'ESCALATE' WHEN ok AND exact_ THEN 'AUTO' ELSE 'HUMAN_REVIEW' END AS outcome, coalesce(array_to_string(reasons, '; '), '') AS reasons FROM d)"""


@query("decision_tree", f"WITH {_DECIDED} SELECT script, outcome FROM e")
def decision_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.decide(graded(spark, sf_dir)).select("script", "outcome")


@query("decision_reasons", f"WITH {_DECIDED} SELECT script, reasons FROM e")
def decision_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.decide(graded(spark, sf_dir)).select("script", F.array_join("reasons", "; ").alias("reasons"))


@query("outcome_counts", f"WITH {_DECIDED} SELECT outcome, count(*) AS n FROM e GROUP BY outcome")
def outcome_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.decide(graded(spark, sf_dir)).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


@query("stale_answers", """
SELECT DISTINCT user_id AS script_id, CASE WHEN user_id % 3 = 0 THEN NULL ELSE 'c' || user_id END AS origin FROM events
WHERE NOT EXISTS (SELECT 1 FROM customer WHERE CASE WHEN user_id % 3 = 0 THEN c_custkey = user_id ELSE c_custkey = user_id AND c_nationkey < 12 END AND c_nationkey < 12)""")
def stale_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers whose script is no longer in the corpus (here: customers of nations from 12 on)."""
    uid = F.col("user_id")
    answers = table(spark, sf_dir, "events").select(uid.cast("string").alias("script_id"), F.when(uid % 3 != 0, F.concat(F.lit("c"), uid.cast("string"))).alias("origin"))
    known = table(spark, sf_dir, "customer").where("c_nationkey < 12").select(F.col("c_custkey").cast("string").alias("id"), F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("origin"))
    return D.match_origins(answers, known)[1].select(F.col("script_id").cast("long").alias("script_id"), "origin")
