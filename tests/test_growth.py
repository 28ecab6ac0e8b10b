"""Queries whose work once grew faster than their tables."""

from collections import Counter

import numpy as np

import __spark_entry__
from scriptloom.operators import regression, sampling, splits


def test_substr_join_counts_before_it_joins(spark, tmp_path):
    names = [None, "", "a", *[f"c{i % 7:02d}" for i in range(900)]]
    for side, key in (("customer", "c"), ("supplier", "s")):
        spark.createDataFrame(list(enumerate(names)), f"{key}_key long, {key}_name string").write.parquet(f"{tmp_path}/{side}.parquet")
    found = __spark_entry__.queries()["substr_join"](spark, str(tmp_path))
    sizes = Counter(n[-2:] for n in names[3:])
    got = {r.tail: r.n for r in found.collect()}
    assert {t: n for t, n in got.items() if t in sizes} == {t: n * n for t, n in sizes.items()}
    assert None not in got
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    # Both sides of the join are counted, so it meets a row a tail.
    assert plan.index("Join") < plan.index("Aggregate") and plan.count("Aggregate") == 2


def test_sums_of_folds_reach_the_driver_once_a_pass(spark):
    rows = spark.createDataFrame([(i % 2, [float(i), 1.0]) for i in range(400)], "key long, values array<double>")
    for parts in (6, 40):
        dealt = rows.repartition(parts)
        assert splits.summed(dealt, 2).rdd.getNumPartitions() <= 2
        found = splits.sums_by_key(dealt, 2)
        assert {k: v.tolist() for k, v in found.items()} == {k: [float(sum(range(k, 400, 2))), 200.0] for k in (0, 1)}


def test_refitted_folds_of_a_table_in_parts(spark, monkeypatch):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(60, 2))
    y = x[:, 0] + 0.3 * rng.normal(size=60) > 0
    rows = spark.createDataFrame([(i, float(a), float(b), bool(g)) for i, ((a, b), g) in enumerate(zip(x, y))], "i long, a double, b double, gold boolean").repartition(5)
    told = []
    direct = regression.sums_by_key
    monkeypatch.setattr(regression, "sums_by_key", lambda df, keys=None: told.append(keys) or direct(df, keys))
    got = {r.row_id: r.p for r in regression.leave_one_out(rows, ["a", "b"], "gold", "i", {"all": []}).collect()}
    scaled = regression.standardise(x)
    for i in range(60):
        rest = np.arange(60) != i
        want = regression.predict_logistic(regression.fit_logistic(scaled[rest], y[rest].astype(float)), scaled[i : i + 1])[0]
        assert abs(got[i] - want) < 1e-7
    # Folds were refitted, and each pass named how many arrays may come.
    assert 1 in told


def test_a_sample_ranks_only_rows_that_may_be_in_it(spark, monkeypatch):
    rows = [(f"n{i}", ("low", "high")[i % 3 == 0], i % 4) for i in range(900)] + [(None, "low", 0), ("alone", "high", 9)]
    df = spark.createDataFrame(rows, "name string, band string, points long").repartition(5)
    plan = {r.band: r.quota for r in sampling.quotas(df, "band", 10).collect()}
    want = {tuple(r) for r in sampling.spread_within_band(df, "name", "band", "points").collect() if r.turn <= plan[r.band]}
    ranked, number = [], sampling.number_within
    monkeypatch.setattr(sampling, "number_within", lambda d, *rest: ranked.append(d.count()) or number(d, *rest))
    got = [tuple(r) for r in sampling.stratified_fill(df, "name", "band", "points", 10).collect()]
    assert set(got) == want and len(got) == len(want) == 10
    # Ten rows of each score of each band at most.
    assert max(ranked) <= 10 * 9
