"""Windows are cut once for each text, and answers keep what a scorer leaves out."""

from pyspark.sql import functions as F

from scriptloom.functions import text as T
from scriptloom.operators import decisions as D
from scriptloom.plans.grading import ASKED, by_length
from scriptloom.plans.texts import scripts

DATA = "/root/testdata/sf0.001"


def _folds(df) -> int:
    return df._jdf.queryExecution().optimizedPlan().toString().count("aggregate(")


def test_texts_are_cut_once(spark):
    rows = scripts(spark, DATA)
    assert _folds(D.ask_windows(rows.withColumnRenamed("doc_id", "origin"), ASKED, by_length)) == 1
    assert _folds(T.each_window(rows, "doc_id", T.windows(F.col("sql")))) == 1


def test_scripts_without_code_or_text_keep_one_window(spark):
    rows = spark.createDataFrame([("a", None), ("b", ""), ("c", "-- only\n"), ("d", "select 1")], "origin string, sql string")
    got = D.ask_windows(rows, ASKED, by_length)
    assert sorted((r.script, r.window, r.n_windows) for r in got.collect()) == [(s, 0, None) for s in "abcd" for _ in ASKED]
    # Windows of a text without a line of code are none.
    assert [r.origin for r in T.each_window(rows, "origin", T.windows(F.col("sql"))).collect()] == ["d"]


def test_token_estimate_counts_words_by_ascii_space(spark):
    texts = ["", " ", "a", " a=1  b\t=\n3 c ", "1=2=3 x9y9", "a b 4", " =", "\x0b7\x0c8\r9", "a\x1cb 5", None]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.token_estimate(F.col("t")).alias("n")).collect()

    def plain(t):
        words = [w for w in t.encode().split()]
        return int(len(words) * 1.3 + sum(any(c in b"0123456789=" for c in w) for w in words))

    assert [r.n for r in got] == [None if t is None else plain(t) for t in texts]


def test_answers_without_values_stay_null(spark):
    cards = spark.createDataFrame([("a", "xx"), ("b", "y")], "origin string, state string")

    def scorer(states, question):
        return [{"p_true": None, "score": None, "choice": None} if s == "y" else {"p_true": 1, "score": 2, "choice": "u", "probabilities": [("u", 1)]} for s in states]

    got = {(r.script, r.question): (r.value_num, r.value_str, r.max_probability) for r in D.ask(cards, ASKED, scorer, size=1).collect()}
    assert got["a", "migration_complexity"] == (2.0, None, 1.0) and got["a", "rewrite_strategy"] == (None, "u", 1.0)
    assert got["b", "migration_complexity"] == (0.0, None, 0.0) and got["b", "rewrite_strategy"] == (None, None, 0.0)
