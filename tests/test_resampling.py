"""Stratified splits and what is fitted on them, against plain versions."""

import random
from collections import defaultdict

import numpy as np
import pytest

from scriptloom.operators import comparison as K
from scriptloom.operators import holdout as H
from scriptloom.operators import splits as P
from scriptloom.operators.order_statistics import numbers, order_statistics
from scriptloom.operators.profile import profile, wide_percentiles


def plain_halves(rows, repeats):
    """(group, split) to the ids that train and those that don't, of rows (group, id, class)."""
    classes = defaultdict(list)
    for g, i, c in rows:
        classes[g, c].append(i)
    out = defaultdict(lambda: (set(), set()))
    for (g, _), ids in classes.items():
        hashes = {i: P.split_hashes(np.array([i]), repeats)[0] for i in ids}
        cut = max(2, round(len(ids) * 0.5))
        for s in range(repeats):
            order = sorted(ids, key=lambda i: (int(hashes[i][s]), i))
            out[g, s][0].update(order[:cut])
            out[g, s][1].update(order[cut:])
    return out


def plain_threshold(train, test):
    """threshold, inverted, train and test accuracy of rows (score, gold)."""
    ways = [(c, inv) for c in sorted({0.0, 1.0} | {s for s, _ in train}) for inv in (False, True)]
    share = lambda rows, c, inv: sum(((s >= c) != inv) == y for s, y in rows) / len(rows)
    accuracies = [share(train, *w) for w in ways]
    top = max(accuracies)
    tied = [w for w, a in zip(ways, accuracies) if a == top]
    way = tied[-1] if round(top, 4) < top else tied[0]
    return (*way, top, share(test, *way))


def scored_rows(seed, n=700):
    """Groups of distinct and of repeated scores, one score in two fifths of all rows, two classes of odd sizes."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        g = rng.choice(("a", "b", None))
        s = 0.37 if rng.random() < 0.4 else (round(rng.random(), 2) if g == "a" else rng.uniform(-0.5, 1.5))
        rows.append((g, i * 7_000_003 - 500, s, rng.random() < 0.4 if rng.random() < 0.6 else s > 0.6))
    return rows


def outcomes(spark, rows):
    return spark.createDataFrame(rows, "question string, row_id long, score double, gold_bool boolean").repartition(4)


@pytest.mark.parametrize("few", [64, 1])
def test_halves_are_exact(spark, monkeypatch, few):
    """Equal to sorting, whether the last row of a half is found among many listed rows or by narrowing to one value."""
    monkeypatch.setattr(P, "FEW", few)
    rows = [(g, i, y) for g, i, _, y in scored_rows(1)] + [("t", i, i == 3) for i in range(6)] + [("one", 1, True), ("one", 2, True)]
    got = defaultdict(lambda: (set(), set()))
    for r in P.stratified_splits(spark.createDataFrame(rows, "g string, i long, y boolean").repartition(3), ["g"], "y", "i", 5).collect():
        got[r.g, r.split][0 if r.is_train else 1].add(r.i)
    want = plain_halves([r for r in rows if r[0] != "one"], 5)
    assert dict(got) == dict(want)
    for s in range(5):
        for y in (True, False):
            ids = {i for g, i, c in rows if g == "a" and c is y}
            assert len(got["a", s][0] & ids) == max(2, round(len(ids) / 2))


def test_three_classes_repeated_ids_and_rows_that_go(spark):
    rows = [(i, i % 3) for i in range(90)] + [(7, 1)] * 40 + [(None, 1), (200, None)]
    split = P.stratified_splits(spark.createDataFrame(rows, "i long, c int"), [], "c", "i", 4, classes=3).collect()
    assert {r.i for r in split} == set(range(90)) and len(split) == 130 * 4
    assert len({(r.i, r.split, r.is_train) for r in split}) == 90 * 4
    for s in range(4):
        assert sum(r.is_train for r in split if r.split == s and r.c == 0) == 15
    empty = P.stratified_splits(spark.createDataFrame([], "i long, c int"), [], "c", "i", 4)
    assert empty.count() == 0 and empty.columns == ["i", "c", "split", "is_train"]


def test_a_first_guess_that_misses(spark, monkeypatch):
    """Ids whose hashes crowd at one end: the interval opens again and the cut is exact."""
    monkeypatch.setattr(P, "FEW", 1)
    many = np.arange(60_000)
    low = many[P.split_hashes(many, 1)[:, 0] < np.uint64(2**60)]
    rows = [(int(i), True) for i in low] + [(int(i), False) for i in many[:40]]
    got = P.stratified_splits(spark.createDataFrame(rows, "i long, y boolean"), [], "y", "i", 1).collect()
    for y in (True, False):
        want = plain_halves([(None, i, z) for i, z in rows if z is y], 1)[None, 0][0]
        assert {r.i for r in got if r.is_train and r.y is y} == want and len(want) > 10


def test_run_counts():
    rng = np.random.default_rng(0)
    for splits in (1, 64, 130):
        bits = rng.random((83, splits)) < 0.4
        starts = np.array([0, 1, 2, 33, 34, 80])
        assert (H.run_counts(H.packed(bits), starts, splits) == np.add.reduceat(bits.astype(int), starts, axis=0)).all()


@pytest.mark.parametrize("block, runs", [(1 << 14, 1 << 11), (16, 3)])
def test_threshold_halves(spark, monkeypatch, block, runs):
    """One cut a split, whatever blocks and tasks a score's rows fall in."""
    monkeypatch.setattr(H, "BLOCK", block)
    monkeypatch.setattr(H, "RUNS", runs)
    rows = scored_rows(2) + [("few", i, 0.5, i < 3) for i in range(20)] + [("z", 1, None, True), ("z", 2, 0.5, None), ("a", 5, float("nan"), True)]
    got = {(r.question, r.split): r for r in H.threshold_halves(outcomes(spark, rows), ["question"], "row_id", 6).collect()}
    used = [r for r in rows if r[0] not in ("few", "z") and r[2] == r[2]]
    value = {(g, i): (s, y) for g, i, s, y in used}
    want = plain_halves([(g, i, y) for g, i, _, y in used], 6)
    assert set(got) == set(want)
    for (g, s), (train, test) in want.items():
        r = got[g, s]
        found = plain_threshold([value[g, i] for i in train], [value[g, i] for i in test])
        assert (r.threshold, r.inverted, r.n_test) == (*found[:2], len(test))
        assert abs(r.train_accuracy - found[2]) < 1e-12 and abs(r.test_accuracy - found[3]) < 1e-12


def test_holdout_summary(spark):
    rows = scored_rows(3, 200)
    got = {r.question: r for r in K.holdout_summary(outcomes(spark, rows), "row_id", 70, ["question"]).collect()}
    for g in ("a", "b", None):
        own = {i: (s, y) for q, i, s, y in rows if q == g}
        halves = plain_halves([(g, i, y) for i, (_, y) in own.items()], 70)
        fits = [plain_threshold([own[i] for i in train], [own[i] for i in test]) for train, test in halves.values()]
        tested, cuts = sorted(f[3] for f in fits), sorted(f[0] for f in fits)
        hindsight = plain_threshold(list(own.values()), list(own.values()))[2]
        half = sum((s >= 0.5) == y for s, y in own.values()) / len(own)
        r = got[g]
        mean = sum(tested) / 70
        want = (mean, tested[3], tested[66], cuts[35], cuts[0], cuts[-1], half, hindsight, hindsight - mean, mean - half)
        names = ("mean", "p05", "p95", "median_threshold", "least_threshold", "largest_threshold", "accuracy_at_half", "hindsight", "gap", "gain")
        assert r.n == 70 and [round(r[c], 9) for c in names] == [round(x, 9) for x in want]
    one = K.holdout_summary(outcomes(spark, rows).drop("question"), "row_id", 5).collect()
    assert len(one) == 1 and one[0].n == 5
    assert K.holdout_summary(outcomes(spark, [r for r in rows if r[3]]), "row_id", 5, ["question"]).count() == 0


def test_order_statistics(spark):
    """All ranks of columns of both signs, of whole numbers, of one value, and with NaN and infinities."""
    rng = np.random.default_rng(4)
    columns = [rng.normal(size=301) * 10.0 ** rng.integers(-300, 300, 301), rng.integers(-5, 5, 301) * 1.0, np.full(301, 2.5), rng.normal(size=301)]
    columns[3][:5] = [np.nan, np.inf, -np.inf, -0.0, 0.0]
    rows = spark.createDataFrame([tuple(float(c[i]) for c in columns) for i in range(301)], "a double, b double, c double, d double").repartition(3)
    ranks = list(range(1, 302, 3))
    got = order_statistics(numbers(rows, ["a", "b", "c", "d"]), 4, lambda n: ranks if n == 301 else [])
    for c, g in zip(columns, got):
        assert np.array_equal(np.sort(c)[np.array(ranks) - 1], np.array(g), equal_nan=True)
    empty = spark.createDataFrame([], "a double, b double")
    assert profile(empty, ["a", "b"]).count() == 0 and wide_percentiles(empty, ["a"]).count() == 0
    nulls = profile(spark.createDataFrame([(None,), (3.0,)], "a double"), ["a"]).first()
    assert (nulls.n, nulls.zeros, nulls.p25, nulls.p95) == (2, 1, 0.0, 3.0)
