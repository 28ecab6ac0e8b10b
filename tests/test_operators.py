"""Operators against plain restatements of what they compute."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from scriptloom.functions import sqlparse
from scriptloom.functions import text as T
from scriptloom.operators import comparison as K
from scriptloom.operators import decisions as D
from scriptloom.operators import labels as L
from scriptloom.operators import metrics as M
from scriptloom.operators import regression as G
from scriptloom.operators import rubric as R
from scriptloom.operators import sampling as S
from scriptloom.operators import training as TR
from scriptloom.operators.profile import PERCENTILES, percentiles, profile
from scriptloom.operators.ranking import number_within, sum_before, sums_before
from scriptloom.operators.script_features import specificity, structure


def one(df):
    return df.collect()[0]


# -- Ranking and percentiles ------------------------------------------------------


def test_running_sums(spark):
    rng = random.Random(0)
    rows = [(rng.choice("ab") if i % 9 else None, rng.randrange(50), i, rng.randrange(5)) for i in range(500)]
    df = spark.createDataFrame(rows, "k string, o long, id long, w long").repartition(7)
    got = {r.id: (r.s, r.n) for r in number_within(sum_before(df, ["k"], ["o", "id"], "w", "s"), ["k"], ["o", "id"], "n").collect()}
    for key in ("a", "b", None):
        total = 0
        for n, r in enumerate(sorted((x for x in rows if x[0] == key), key=lambda x: (x[1], x[2]))):
            assert got[r[2]] == (total, n)
            total += r[3]


def nearest(values, p):
    n = len(values)
    return sorted(values)[min(max(round(p / 100 * n + 0.5), 1), n) - 1]


@pytest.mark.parametrize("n", [1, 2, 7, 100, 101])
def test_percentiles_are_observed_values(spark, n):
    rng = random.Random(n)
    values = [float(rng.randrange(20)) for _ in range(n)]
    row = one(percentiles(spark.createDataFrame([("x", v) for v in values], "f string, v double"), "f", "v"))
    assert [row[f"p{p}"] for p in PERCENTILES] == [nearest(values, p) for p in PERCENTILES]


def test_profile(spark):
    row = one(profile(spark.createDataFrame([(0,), (3,), (None,), (9,)], "x int"), ["x"]))
    assert (row.n, row.min, row.max, row.zeros, row["mean"]) == (4, 0, 9, 2, 3) and math.isclose(row.stdev, np.std([0, 3, 0, 9], ddof=1))
    assert one(profile(spark.createDataFrame([(4,)], "x int"), ["x"])).stdev == 0


# -- Rubric -----------------------------------------------------------------------


def plain_bands(scores):
    best = None
    n = len(scores)
    for t1, t2 in itertools.product(range(max(scores) + 1), repeat=2):
        if t2 >= t1 + 2:
            sizes = [sum(s <= t1 for s in scores), sum(t1 < s <= t2 for s in scores), sum(s > t2 for s in scores)]
            if sizes[1] and sizes[2]:
                cost = round(sum(abs(x - n / 3) for x in sizes), 6)
                if best is None or cost < best[0]:
                    best = (cost, t1, t2, *sizes)
    return best[1:]


@pytest.mark.parametrize("scores", [[i % 9 for i in range(90)], [5] * 40 + [6] * 30 + [i % 4 for i in range(20)] + [9, 12, 15], [0, 2, 3, 7]])
def test_choose_bands(spark, scores):
    assert tuple(one(R.choose_bands(spark.createDataFrame([(s,) for s in scores], "p long"), "p"))) == plain_bands(scores)


def test_choose_bands_without_cuts(spark):
    assert tuple(one(R.choose_bands(spark.createDataFrame([(4,), (4,)], "p long"), "p"))) == (4, 5, 2, 0, 0)
    assert tuple(one(R.choose_bands(spark.createDataFrame([], "p long"), "p"))) == (3, 7, 0, 0, 0)


def test_tiers_never_stack(spark):
    limits = spark.createDataFrame([("a", 5, 10), ("b", 1, None)], "feature string, lower long, upper long")
    rows = spark.createDataFrame([(0, 0), (5, 0), (10, 3), (None, 1)], "a long, b long")
    got = [(r.points, len(r.reasons)) for r in R.score(rows, limits, [("flat", "a > 9")]).collect()]
    assert got == [(0, 0), (1, 1), (4, 3), (1, 1)]
    assert one(R.band_for(spark.createDataFrame([(-1,)], "points long"), [("low", 0, 4)])).band == "high"


# -- Metrics ----------------------------------------------------------------------


def scored(spark, rows):
    return spark.createDataFrame([("g", float(s), g) for s, g in rows], "k string, score double, gold_bool boolean")


@pytest.mark.parametrize("seed", range(4))
def test_auc_is_the_share_of_pairs(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.randrange(6) / 5, rng.random() < 0.4) for _ in range(60)]
    p, n = [s for s, g in rows if g], [s for s, g in rows if not g]
    want = sum((a > b) + (a == b) / 2 for a in p for b in n) / (len(p) * len(n))
    assert math.isclose(one(M.roc_auc(scored(spark, rows), ["k"])).auc, want)
    assert one(M.roc_auc(scored(spark, [(0.5, True)]), ["k"])).auc is None


def test_best_threshold_is_the_best(spark):
    rng = random.Random(5)
    rows = [(rng.randrange(30) / 29, rng.random() < 0.5) for _ in range(37)]
    cuts = sorted({s for s, _ in rows} | {0.0, 1.0})
    accuracy = {(t, i): sum(((s >= t) != i) == g for s, g in rows) / len(rows) for t in cuts for i in (False, True)}
    top = max(accuracy.values())
    tied = [k for k, v in accuracy.items() if v == top]
    row = one(M.best_threshold(scored(spark, rows), ["k"]))
    assert row.accuracy == top and (row.threshold, row.inverted) == (max(tied) if round(top, 4) < top else min(tied))


def test_mcnemar_and_wilson(spark):
    df = spark.createDataFrame([("x", True, False)] * 15 + [("x", False, True)] * 17 + [("x", True, True)] * 67 + [("y", True, True)] * 3, "k string, l boolean, r boolean")
    p = {r.k: r.p for r in M.mcnemar(df, ["k"], "l", "r").collect()}
    assert round(p["x"], 5) == 0.86005 and p["y"] == 1.0
    big = one(M.mcnemar(spark.createDataFrame([("x", 3000, 3100)], "k string, b int, c int").select("k", F.explode(F.concat(F.array_repeat(F.lit(True), 3000), F.array_repeat(F.lit(False), 3100))).alias("l")).withColumn("r", ~F.col("l")), ["k"], "l", "r"))
    assert 0.1 < big.p < 0.3
    rows = M.wilson_interval(spark.createDataFrame([(8, 8), (0, 0), (3, 10)], "hits long, n long")).collect()
    assert round(rows[0].low, 4) == 0.6756 and rows[0].high == 1.0 and (rows[1].low, rows[1].high) == (0, 1) and rows[2].low < 0.3 < rows[2].high


def test_ungradable_rows_are_excluded(spark):
    rows = [("q", "true", "true", True, True, 0.9), ("q", "false", "true", False, True, 0.7), ("q", None, "true", False, False, 0.99)]
    o = spark.createDataFrame(rows, "question string, gold string, predicted string, agree boolean, gradable boolean, confidence double")
    assert tuple(one(M.accuracy(o, ["question"])))[1:] == (1, 2, 0.5)
    assert math.isclose(one(M.brier(o, ["question"])).brier, (0.01 + 0.49) / 2)
    assert math.isclose(one(M.calibration_error(o)).ece, (0.1 + 0.7) / 2)
    assert [r.kept for r in M.coverage_curve(o, (0.5, 0.8)).orderBy("cut").collect()] == [2, 1]
    assert {r.gold: (r.pred_true, r.pred_false) for r in M.confusion(o, ["true", "false"]).collect()} == {"true": (1, 0), "false": (1, 0)}


def test_spearman(spark):
    df = spark.createDataFrame([("a", 1, 3), ("a", 2, 2), ("a", 3, 1), ("b", 1, 1), ("b", 1, 2), ("b", 1, 3), ("c", 1, 1)], "k string, x long, y long")
    got = {r.k: r.rho for r in M.spearman(df, ["k"], "x", "y").collect()}
    assert math.isclose(got["a"], -1) and got["b"] is None and got["c"] is None


# -- Answers and decisions -------------------------------------------------------------


def answer(question, value, kind="noul", probabilities=()):
    return ("s", question, kind, value, None, list(probabilities), max([p for _, p in probabilities], default=max(value, 1 - value)))


ANSWER = "script string, question string, type string, value_num double, value_str string, probabilities array<struct<label:string,p:double>>, max_probability double"


@pytest.mark.parametrize(
    "values,gold,want",
    [
        ((0.95, 0.9, 0.1, (0.1, 0.8, 0.1)), ("true", "true", "false", "medium"), "AUTO"),
        ((0.95, 0.9, 0.9, (0.1, 0.8, 0.1)), ("true", "true", "false", "medium"), "ESCALATE"),
        ((0.95, 0.9, 0.1, (0.8, 0.1, 0.1)), ("true", "true", "false", "high"), "ESCALATE"),
        ((0.95, 0.7, 0.1, (0.1, 0.8, 0.1)), ("true", "true", "false", "medium"), "HUMAN_REVIEW"),
        ((0.95, 0.9, 0.9, (0.1, 0.8, 0.1)), ("true", "true", None, "medium"), "AUTO"),
        ((0.95, 0.9, 0.1, (0.1, 0.8, 0.1)), ("true", "true", "false", None), "HUMAN_REVIEW"),
    ],
)
def test_decisions(spark, values, gold, want):
    names = (*D.VERIFIABLE, D.COMPLEXITY)
    rows = [answer(q, v) if not isinstance(v, tuple) else answer(q, 0.0, "score", zip(R.BAND_ORDER, v)) for q, v in zip(names, values)]
    labels = spark.createDataFrame([("s", q, g) for q, g in zip(names, gold) if g], "script string, question string, gold string")
    assert one(D.decide(D.grade(spark.createDataFrame(rows, ANSWER), labels))).outcome == want


def test_first_largest_window_wins(spark):
    rows = [("s", "has_subquery", i, "noul", v, None, m) for i, (v, m) in enumerate([(0.2, 0.8), (0.7, 0.7), (0.7, 0.9)])] + [("s", "rewrite_strategy", i, "choice", None, s, m) for i, (s, m) in enumerate([("a", 0.5), ("b", 0.8), ("c", 0.8)])]
    df = spark.createDataFrame(rows, "script string, question string, window int, type string, value_num double, value_str string, max_probability double")
    assert {r.question: (r.window, r.n_windows) for r in D.combine_windows(df).collect()} == {"has_subquery": (1, 3), "rewrite_strategy": (1, 3)}


def test_normalise(spark):
    schema = "type string, choice string, score double, p_true double, legend array<string>, probabilities array<struct<label:string,p:double>>"
    rows = [("noul", None, None, 0.8, None, None), ("choice", "b", None, None, None, [("a", 0.3), ("b", 0.7)]), ("score", None, 1.4, None, ["low", "mid", "top"], [("0", 0.2), ("1", 0.5), ("2", 0.3)])]
    got = [(r.label, r.value_num, r.value_str, r.max_probability, [x.label for x in r.probabilities]) for r in D.normalise(spark.createDataFrame(rows, schema)).collect()]
    assert got == [("true", 0.8, None, 0.8, ["true", "false"]), ("b", None, "b", 0.7, ["a", "b"]), ("mid", 1.4, None, 0.5, ["low", "mid", "top"])]


# -- Texts --------------------------------------------------------------------------


def test_windows_partition_the_lines(spark):
    rng = random.Random(1)
    for budget in (5, 40, 380):
        text = "\n".join(" ".join(rng.choice(["select", "x=1", "from", "t2", ""]) for _ in range(rng.randint(0, 30))) + "  " for _ in range(40)) + "\n-- gone\n/* gone\n too */"
        df = spark.createDataFrame([(text,)], "sql string")
        lines, windows = one(df.select(T.lines(T.strip_comments(F.col("sql"))), T.windows(F.col("sql"), budget)))
        assert "\n".join(windows) == "\n".join(lines)
        cost = lambda x: max(1, int(len(x.split()) * 1.3 + sum(any(c.isdigit() or c == "=" for c in w) for w in x.split())))
        assert all(sum(map(cost, w.split("\n"))) <= budget or "\n" not in w for w in windows)
        for a, b in itertools.pairwise(windows):
            assert sum(map(cost, a.split("\n"))) + cost(b.split("\n")[0]) > budget
    assert one(spark.createDataFrame([("-- only\n",)], "sql string").select(T.windows(F.col("sql")).alias("w"))).w == []


def test_lists_and_plurals(spark):
    df = spark.createDataFrame([([],), (["a"],), (["a", "b"],), (["a", "b", "c"],)], "x array<string>")
    assert [r.s for r in df.select(T.join_list(F.col("x"), "or").alias("s")).collect()] == ["", "a", "a or b", "a, b or c"]
    n = spark.createDataFrame([(1,), (2,)], "n long")
    assert [tuple(r) for r in n.select(T.plural(F.col("n"), "subquery"), T.plural(F.col("n"), "key")).collect()] == [("1 subquery", "1 key"), ("2 subqueries", "2 keys")]


# -- Scripts ----------------------------------------------------------------------------


def test_star_of_comma_joins():
    f = structure("select count(*) from store_sales, household_demographics, time_dim, store where ss_sold_time_sk = t_time_sk and ss_hdemo_sk = hd_demo_sk and ss_store_sk = s_store_sk and t_hour = 8")
    assert (f["source_tables"] if "source_tables" in f else len(f["distinct_sources"]), f["widest_scope_shape"], f["graph_edges"], f["implicit_joins"], f["unresolved_predicates"], f["cross_join_risk"]) == (4, "star", 3, 3, 0, 0)


def test_scopes_and_ctes():
    f = structure("with a as (select x from t union all select x from u), b as (select * from a) select * from b join (select y from v) d on b.x = d.y where exists (select 1 from w where w.k = d.y)")
    assert (f["cte_count"], f["derived_table_count"], f["scalar_subquery_count"], f["subquery_count"], f["set_operation_count"], f["union_all_count"], f["cte_references"], f["table_references"]) == (2, 1, 1, 2, 1, 1, 2, 4)
    assert f["distinct_sources"] == ["t", "u", "v", "w"] and f["max_nesting_depth"] == 2 and f["truly_correlated_count"] == 1


def test_windows_cases_and_aggregates():
    f = structure("select distinct k, rank() over (partition by k order by sum(v) desc) r, case when a then 1 when b then 2 else 3 end c, max(x) filter (where x > 0) from t group by rollup(k) having count(*) > 1")
    assert (f["window_function_count"], f["case_expression_count"], f["case_max_branches"], f["distinct_aggregates"]) == (1, 1, 2, ["count", "max", "rank", "sum"])
    assert f["has_distinct"] and f["has_having"] and f["has_order_by"]


def test_dialects_and_errors():
    assert sqlparse.parse("select top 5 x from t")[1] == "tsql"
    assert sqlparse.parse("select a from t; select b from u")[0][1].sources[0].name == "u"
    trees, dialect, error = sqlparse.parse("select from where")
    assert not trees and not dialect and error
    assert not structure("")["parse_ok"] and structure("select 'a;b -- c' from t")["statements"] == 1


def test_unresolved_and_cross_joins():
    assert structure("select 1 from a, b")["cross_join_risk"] == 2
    f = structure("select 1 from a, b where substr(a.z, 1, 2) = substr(b.z, 1, 2)")
    assert (f["unresolved_predicates"], f["cross_join_risk"]) == (1, 0)
    assert structure("select 1 from inventory, item where inv_item_sk = i_item_sk")["graph_edges"] == 1


def test_specificity_is_ordered():
    marks = [specificity(p, "store_sales", a) for p, a in (("store_sales", None), ("x", "X"), ("ss", None), ("store", None), ("s", None), ("zz", None))]
    assert marks == [100, 95, 90, 55, 10, 0] and specificity("t", "time_dim", None) == 80


# -- Sampling, splits, labels -----------------------------------------------------------


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(2)
    rows = []
    for i in range(60):
        points = rng.randrange(12)
        rows.append((f"q{i:02d}", points, "low" if points <= 4 else "medium" if points <= 6 else "high", rng.randrange(9), rng.randrange(5), rng.randrange(4), 1))
    return spark.createDataFrame(rows, "name string, rubric_points long, rubric_band string, subquery_count long, graph_nodes long, window_function_count long, statements long")


def test_samples_repeat_and_cover(corpus):
    bands = {"low": (0, 4), "medium": (5, 6), "high": (7, None)}
    first = S.select(corpus, 20, bands).orderBy("id").collect()
    assert first == S.select(corpus, 20, bands).orderBy("id").collect()
    assert len({r.origin for r in first}) == len(first) == 20
    assert {r.rubric_band for r in first} == {"low", "medium", "high"}
    assert [r.rubric_points for r in first] == sorted(r.rubric_points for r in first)
    assert sum("just" in w for r in first for w in r.selected_because) == 4 and all(0 < r.corpus_percentile["rubric_points"] <= 100 for r in first)


def test_fill_takes_scores_in_turns(corpus):
    got = S.stratified_fill(corpus, "name", "rubric_band", "rubric_points", 18).collect()
    assert len(got) == 18
    low = {r.rubric_points for r in got if r.rubric_band == "low"}
    assert {0, 4} <= low or len(low) >= 2


def test_families_are_never_split(spark):
    df = spark.createDataFrame([(i, f"f{i % 23 if i % 2 else 0}") for i in range(300)], "id long, family string")
    out = TR.split_families(df)
    report = {r.split: (r.cases, r.overlap) for r in TR.split_report(out).collect()}
    assert sum(c for c, _ in report.values()) == 300 and all(o == 0 for _, o in report.values()) and report["train"][0] >= 150


def test_runs_of_families_are_dealt_as_if_one_by_one():
    rng = random.Random(6)
    for _ in range(300):
        sizes = [(n, rng.choice((1, 2, 5, 40, 700))) for n in rng.sample(range(1, 60), rng.randint(1, 9))]
        fractions = rng.choice((TR.SPLITS, {"a": 0.5, "b": 0.5}, {"a": 1.0}, {"a": 0.34, "b": 0.33, "c": 0.33}))
        total, held, want = sum(n * k for n, k in sizes), dict.fromkeys(fractions, 0), {}
        for n, k in sorted(sizes, reverse=True):
            for _ in range(k):
                s = min(fractions, key=lambda s: held[s] - fractions[s] * total)
                held[s] += n
                want[n, s] = want.get((n, s), 0) + 1
        dealt = TR.deal(sizes, fractions)
        assert {(n, s): b - a for n, s, a, b in dealt} == want
        assert all(sorted(r for n, _, a, b in dealt if n == size for r in range(a, b)) == list(range(k)) for size, k in sizes)


def test_cases(spark, tmp_path):
    schema = "id string, name string, purpose string, structure string, facts string, source_tables long, distinct_sources array<string>, gold map<string,string>"
    rows = [("1", "a", "p", "s", "f", 2, ["t"], {"b": "true", "c": "x", "k": "high"}), ("2", "b", None, None, None, 2, ["t"], {"b": "true"}), ("3", "c", "p", "", "", 2, ["t"], {"c": "unknown"})]
    asked = [{"qid": "b", "type": "noul"}, {"qid": "c", "type": "choice", "criteria": {"x": "", "y": ""}}, {"qid": "k", "type": "score", "criteria": ["low", "medium", "high"]}]
    cases = TR.build_cases(spark.createDataFrame(rows, schema), asked)
    row = one(cases)
    import json

    gold = json.loads(row.gold)
    assert cases.count() == 1 and gold["b"]["probabilities"] == {"true": 1.0, "false": 0.0} and gold["c"]["label"] == "x" and gold["k"]["label"] == "2"
    assert {(r.question, r.label): r.n for r in TR.label_counts(cases).collect()} == {("b", "true"): 1, ("c", "x"): 1, ("k", "2"): 1}
    TR.write_jsonl(TR.split_families(cases), f"{tmp_path}/out")
    assert spark.read.json(f"{tmp_path}/out").count() == 1


def test_labels(spark):
    side = lambda rows: spark.createDataFrame(rows, "name string, subquery_count long, cte_count long, distinct_sources array<string>, parse_ok boolean, parse_dialect string, nonportable_markers array<string>")
    before = side([(n, 1, 0, ["a", "b"], True, "tsql", ["select_top"]) for n in "vwxyz"])
    after = side([("v", 1, 0, ["a", "b"], True, "spark", []), ("w", 2, 1, ["a", "b"], True, "tsql", ["select_top"]), ("x", 1, 0, ["a", "c"], True, "tsql", ["select_top"]), ("y", 1, 0, ["c", "d", "e"], True, "tsql", []), ("z", 0, 0, [], False, "", [])])
    got = {r.name: (r.strategy, r.confidence) for r in L.derive(before, after).collect()}
    assert got == {"v": ("lift_and_shift", "high"), "w": ("refactor", "high"), "x": ("redesign", "high"), "y": ("manual_rewrite", "high"), "z": ("manual_rewrite", "low")}


# -- Comparison --------------------------------------------------------------------------


def test_regression_stays_finite_and_leaves_rows_out(spark):
    x = np.arange(60)[:, None] * 1.0
    y = (np.arange(60) > 30) * 1.0
    beta = G.fit_logistic(G.standardise(x), y)
    assert np.isfinite(beta).all() and ((G.predict_logistic(beta, G.standardise(x)) > 0.5) == y).all()
    rows = spark.createDataFrame([(i, float(i), 1.0, bool(i % 2)) for i in range(12)] + [(50, 1.0, 1.0, None)], "id long, a double, b double, gold boolean")
    got = G.leave_one_out(rows, ["a", "b"], "gold", "id", {"clean": ["a"], "leaky": []}).collect()
    assert len(got) == 24 and {r.row_id for r in got} == set(range(12))
    assert G.leave_one_out(rows.where("gold"), ["a"], "gold", "id", {"clean": []}).count() == 0


def test_paired_arms(spark):
    rng = random.Random(3)
    rows = [(i, i % 4, 20 + i, i % 4 > 0, min(1.0, max(0.0, (0.9 if i % 4 else 0.1) + rng.uniform(-0.05, 0.05)))) for i in range(60)]
    df = spark.createDataFrame(rows, "row_id long, subquery_count long, loc_code long, gold boolean, score double")
    splits = K.seeded_splits(spark, [[r[0] for r in rows if r[3]], [r[0] for r in rows if not r[3]]], 12)
    sizes = splits.groupBy("split").agg(F.count_if("is_train").alias("n")).collect()
    assert all(r.n == round(45 / 2) + round(15 / 2) for r in sizes)
    arms = G.paired_splits(df, splits, ["subquery_count", "loc_code"], "gold", "score", "row_id", ["subquery_count"])
    table = {(r.measure, r.arm): r for r in G.paired_summary(arms).collect()}
    assert table["accuracy", "classifier"]["mean"] > 0.95 and table["accuracy", "lr_leaky"]["mean"] > 0.9 and table["lead", "majority"].verdict == "win"


def test_cuts(spark):
    rng = random.Random(4)
    rows = [(round(rng.random() * 2, 1), rng.randrange(3)) for _ in range(80)]
    grid = sorted({v for v, _ in rows})
    place = lambda v, lo, hi: 0 if v < lo else 1 if v < hi else 2
    best = max(((sum(place(v, lo, hi) == g for v, g in rows), -lo, -hi) for lo in grid for hi in grid if lo <= hi))
    row = one(K.fit_cuts(spark.createDataFrame([("x", v, g) for v, g in rows], "k string, value double, level long"), ["k"]))
    assert (row.hits, row.low, row.high) == (best[0], -best[1], -best[2])
    few = one(K.fit_cuts(spark.createDataFrame([("x", 1.0, 0), ("x", 2.0, 1)], "k string, value double, level long"), ["k"]))
    assert (few.low, few.high) == (0, 0)


def test_wordings(spark):
    x = spark.createDataFrame([([0.1, 0.2, 0.9, 0.4],)], "x array<double>")
    got = one(x.select(*[f(F.col("x")).alias(n) for n, f in K.AGGREGATORS.items()]))
    assert math.isclose(got["mean"], 0.4) and math.isclose(got["median"], 0.3) and math.isclose(got["trimmed"], 0.3)
    answers = spark.createDataFrame([("s", "q_p1", 0.2), ("s", "q_p2", 0.4), ("t", "q_p1", 0.9)], "script string, question string, value_num double")
    assert [(r.script, round(r.score, 6)) for r in K.aggregate_scores(answers, ["q_p1", "q_p2"]).collect()] == [("s", 0.3)]
    assert one(spark.createDataFrame([(["b", "a", "b"],)], "x array<string>").select(K.majority_vote(F.col("x")).alias("v"))).v == "b"


def test_negation(spark):
    rows = [("q", v, s / 20 if v != "v3" else 1 - s / 20, s >= 10) for s in range(20) for v in ("v1", "v2", "v3")]
    row = one(K.variant_probe(spark.createDataFrame(rows, "question string, variant string, score double, gold_bool boolean")))
    assert (row.auc_v1, row.auc_v3, row.paraphrase_shift, row.inverted) == (1.0, 0.0, 0.0, True)


def test_latency_fit(spark):
    row = one(M.ols_line(spark.createDataFrame([(50.0, 1539.1), (100.0, 2027.3), (200.0, 3027.4), (380.0, 4974.0)], "tokens double, ms double"), "tokens", "ms"))
    assert round(row.slope, 4) == 10.4305 and round(row.intercept, 1) == 988.4


def test_a_scorer_answers_typed_questions(spark):
    cards = spark.createDataFrame([("a", "one two"), ("b", "three")], "origin string, state string")
    asked = [{"qid": "q", "type": "noul"}, {"qid": "c", "type": "choice"}, {"qid": "s", "type": "score"}]

    def scorer(states, question):
        made = {"noul": lambda n: {"p_true": n / 10}, "choice": lambda n: {"choice": "x", "probabilities": [("x", 0.7), ("y", 0.3)]}, "score": lambda n: {"score": 1.2, "legend": ["low", "mid", "top"], "probabilities": [("0", 0.1), ("1", 0.6), ("2", 0.3)]}}
        return [made[question["type"]](len(s)) for s in states]

    got = {(r.script, r.question): (r.value_num, r.value_str, r.label, r.max_probability) for r in D.ask(cards, asked, scorer).collect()}
    assert got["a", "q"] == (0.7, None, "true", 0.7) and got["b", "c"] == (None, "x", "x", 0.7) and got["a", "s"] == (1.2, None, "mid", 0.6) and len(got) == 6


def test_reports(spark):
    from scriptloom.operators import reports
    from scriptloom.plans.scripts import SCORED, census, corpus

    tables = reports.census_tables(census(corpus(spark)), [x for x, _, _ in SCORED])
    assert {k: t.count() > 0 for k, t in tables.items()} == dict.fromkeys(tables, True)
    rows = [("s", q, "true", "true", True, True, 0.9, "high", True, None) for q in D.VERIFIABLE] + [("s", D.COMPLEXITY, "low", "high", True, False, 0.9, "high", False, 2)]
    outcomes = spark.createDataFrame(rows, "script string, question string, gold string, predicted string, gradable boolean, agree boolean, confidence double, confidence_band string, verifiable boolean, band_gap long")
    made = reports.run_tables(outcomes, list(D.VERIFIABLE))
    assert all(t.count() > 0 for t in made.values()) and one(made["decisions"]).outcome == "ESCALATE"


def test_regression_features():
    assert len(G.FEATURES) == len(set(G.FEATURES)) == 32 and all(set(v) <= set(G.FEATURES) for v in G.LEAKY.values())


def test_mcnemar_of_a_million_pairs(spark):
    import math

    df = spark.range(1_001_000).select(F.lit("x").alias("k"), (F.col("id") < 500_000).alias("l")).withColumn("r", ~F.col("l"))
    row = one(M.mcnemar(df, ["k"], "l", "r"))
    n, k = 1_001_000, 500_000
    # Normal approximation with continuity correction, good to 1e-4 here.
    z = (n / 2 - k - 0.5) / (math.sqrt(n) / 2)
    assert abs(row.p - math.erfc(z / math.sqrt(2))) < 1e-4


def test_fit_cuts_of_many_values(spark):
    n = 100_000
    level = F.when(F.col("id") < 30_000, 0).when(F.col("id") < 80_000, 1).otherwise(2).cast("long")
    row = one(K.fit_cuts(spark.range(n).select(F.lit("x").alias("k"), F.col("id").cast("double").alias("value"), level.alias("level")), ["k"]))
    assert (row.low, row.high, row.hits, row.n) == (30_000.0, 80_000.0, n, n)


def test_sums_and_largest_before(spark):
    rows = [("a" if i % 3 else "b", i * 7919 % 101, i % 5, None if i % 11 == 0 else i % 7) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, o long, w long, v long")
    got = sums_before(df.withColumn("o", F.col("o") * 1000 + F.col("w")), ["k"], ["o"], {"s": "w", "n": None}, {"top": F.col("v") + F.col("s") * 0}).collect()
    for r in got:
        before = [x for x in got if x.k == r.k and x.o < r.o]
        same = [x for x in got if x.k == r.k and x.o == r.o]
        assert sum(x.w for x in before) <= r.s <= sum(x.w for x in before + same) and len(before) <= r.n < len(before + same)
        values = [x.v for x in before if x.v is not None]
        assert r.top is None or r.top >= max(values, default=0)


def test_turns_in_one_band(spark):
    rows = [(f"n{i:03}", "low", i % 4) for i in range(200)]
    turns = S.spread_within_band(spark.createDataFrame(rows, "name string, band string, points long"), "name", "band", "points").collect()
    order = [r.points for r in sorted(turns, key=lambda r: r.turn)]
    assert sorted(r.turn for r in turns) == list(range(1, 201)) and order[:8] == [0, 3, 1, 2, 0, 3, 1, 2]
