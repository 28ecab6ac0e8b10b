"""Distributed fits, leave-one-out and paired splits against fits of whole matrices."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from scriptloom.operators import comparison as K
from scriptloom.operators import regression as G
from scriptloom.operators import splits as P

NAMES = ["a", "b", "c", "flat"]


def table(spark, n, seed, label=None):
    """Correlated features, one with a long tail and one constant; ``b`` has nulls."""
    rng = np.random.default_rng(seed)
    x = np.column_stack([rng.normal(size=n), rng.normal(size=n), np.exp(rng.normal(size=n)), np.full(n, 0.1)])
    x[:, 1] += x[:, 0]
    y = (x[:, 0] - 0.5 * x[:, 1] + rng.logistic(size=n) > 0.3) if label is None else label(x)
    x[::17, 1] = 0
    rows = [(int(i) * 3, *(None if j == 1 and i % 17 == 0 else float(v) for j, v in enumerate(r)), bool(g), round(float(1 / (1 + np.exp(-r[0] + 0.3))), 5)) for i, (r, g) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "row_id long, a double, b double, c double, flat double, gold boolean, score double").repartition(3), x, y.astype(float), np.array([r[-1] for r in rows])


@pytest.mark.parametrize("label", [None, lambda x: x[:, 2] > 1.2])
def test_fit(spark, label):
    """Coefficients within 1e-8 of one fit of the whole matrix, also where the label is a function of a feature."""
    rows, x, y, _ = table(spark, 900, 1, label)
    got = G.fit_table(rows, NAMES, "gold", "row_id", {"clean": ["c"], "all": []}).collect()
    for v, keep in (("clean", [0, 1, 3]), ("all", [0, 1, 2, 3])):
        want = G.fit_logistic(G.standardise(x)[:, keep], y)
        own = [r for r in got if r.variant == v]
        assert [r.feature for r in own] == ["(intercept)", *[NAMES[i] for i in keep]]
        assert np.abs(np.array([r.coefficient for r in own]) - want).max() < 1e-8
    assert G.fit_table(rows.where("gold"), NAMES, "gold", "row_id", {"all": []}).count() == 0


def plain_left_out(x, y, keep):
    scaled = G.standardise(x)[:, keep]
    out = []
    for i in range(len(y)):
        mask = np.arange(len(y)) != i
        out.append(G.predict_logistic(G.fit_logistic(scaled[mask], y[mask]), scaled[i : i + 1])[0] if len(set(y[mask])) > 1 else y[mask][0])
    return np.array(out)


@pytest.mark.parametrize("n, settled", [(120, 1e-8), (500, 1e-4), (500, 0.0)])
def test_leave_one_out(spark, monkeypatch, n, settled):
    """Equal to refits: rows refitted in passes, and (with a loose bound) rows that find their fold from the sums."""
    monkeypatch.setattr(G, "SETTLED", settled)
    rows, x, y, _ = table(spark, n, 2)
    got = {(r.variant, r.row_id): r.p for r in G.leave_one_out(rows, NAMES, "gold", "row_id", {"clean": ["c"], "all": []}).collect()}
    assert len(got) == 2 * n
    for v, keep in (("clean", [0, 1, 3]), ("all", [0, 1, 2, 3])):
        want = plain_left_out(x, y, keep)
        off = np.abs(np.array([got[v, 3 * i] for i in range(n)]) - want).max()
        assert off < max(1e-6, settled)


def test_expansion_and_its_bound(spark):
    """In a larger table the sums alone give most folds, and none is further off than its bound."""
    rows, x, y, _ = table(spark, 3000, 3)
    data = G.design(rows, NAMES, "gold", "row_id")
    places = [0, 1, 2, 3]
    beta = G.fit_models(data, G.Everyone(), {"v": places})["v"][0]
    e = G._expansion(data, places, beta)
    wide = np.column_stack([np.ones(len(x)), data.scaled(x)])
    delta, off = G._left_out(e, wide, y)
    for i in np.random.default_rng(0).choice(len(y), 40, replace=False):
        mask = np.arange(len(y)) != i
        want = G.fit_logistic(data.scaled(x)[mask], y[mask])
        assert abs(wide[i] @ (beta + delta[i] - want)) <= off[i] + 1e-10
    assert np.mean(off < 1e-6) > 0.9


def test_baseline(spark):
    rows, x, y, scores = table(spark, 120, 6)
    got = {r.variant: r for r in G.baseline(rows, NAMES, "gold", "row_id", ["c"], "score").collect()}
    gold, own = y == 1, (scores >= 0.5) == (y == 1)
    for v, keep in (("clean", [0, 1, 3]), ("leaky", [0, 1, 2, 3])):
        p = plain_left_out(x, y, keep)
        right = (p >= 0.5) == gold
        pairs = (p[gold][:, None] > p[~gold]) + 0.5 * (p[gold][:, None] == p[~gold])
        r = got[v]
        assert (r.n, r.n_features, r.b, r.c) == (120, len(keep), int(np.sum(own & ~right)), int(np.sum(~own & right)))
        assert abs(r.accuracy - right.mean()) < 1e-12 and abs(r.classifier_accuracy - own.mean()) < 1e-12
        assert abs(r.auc - pairs.mean()) < 1e-9 and r.low < r.accuracy < r.high and 0 < r.p <= 1
    some = G.baseline(rows.withColumn("score", F.when(F.col("row_id") > 3, F.col("score"))), NAMES, "gold", "row_id", [], "score").collect()
    assert len(some) == 2 and all(r.p is None and r.classifier_accuracy is None and r.auc for r in some)


def test_one_row_of_a_class(spark):
    rows, x, y, _ = table(spark, 30, 4, lambda x: x[:, 0] >= x[:, 0].max())
    got = {r.row_id: r for r in G.leave_one_out(rows, ["a"], "gold", "row_id", {"v": []}).collect()}
    lone = 3 * int(y.argmax())
    assert got[lone].p == 0.0 and len(got) == 30 and got[lone].gold
    assert G.leave_one_out(rows.limit(9), ["a"], "gold", "row_id", {"v": []}).count() == 0
    assert G.leave_one_out(rows, ["a"], "gold", "row_id", {"none": ["a"]}).count() == 30


def plain_paired(x, y, scores, trains, leaky, own_scale):
    """Accuracies of each arm on one split, by whole matrices."""
    train, test = np.flatnonzero(trains), np.flatnonzero(~trains)
    gold = y == 1
    ways = [(c, inv) for c in sorted({*np.round(scores[train], 4), 0.5}) for inv in (False, True)]
    hits = [np.sum(((scores[train] >= c) != inv) == gold[train]) for c, inv in ways]
    cut, inverted = ways[int(np.argmax(hits))]
    out = {"classifier": np.mean(((scores[test] >= cut) != inverted) == gold[test])}
    for arm, keep in (("lr_clean", [i for i, f in enumerate(NAMES) if f not in leaky]), ("lr_leaky", range(len(NAMES)))):
        part = x[:, list(keep)]
        scaled = G.standardise(part)
        if own_scale:
            deviation = part[train].std(axis=0)
            scaled = (part - part[train].mean(axis=0)) / np.where(deviation < 1e-12, 1, deviation)
        beta = G.fit_logistic(scaled[train], y[train])
        out[arm] = np.mean((G.predict_logistic(beta, scaled[test]) >= 0.5) == gold[test])
    out["majority"] = np.mean(gold[test] == (2 * gold[train].sum() >= len(train)))
    return out


@pytest.mark.parametrize("own_scale, seeded", [(False, False), (True, False), (False, True)])
def test_paired_splits(spark, own_scale, seeded):
    rows, x, y, scores = table(spark, 210, 5)
    ids = np.arange(210) * 3
    if seeded:
        splits = K.seeded_splits(spark, G.labelled_groups(rows, "gold", "row_id"), 5)
        trains = np.zeros((210, 5), bool)
        for r in splits.collect():
            trains[r.row_id // 3, r.split] = r.is_train
    else:
        splits, hashes = 5, P.split_hashes(ids, 5)
        trains = np.zeros((210, 5), bool)
        for c in (0, 1):
            own = np.flatnonzero(y == c)
            for s in range(5):
                trains[own[np.argsort(hashes[own, s])[: P.half(len(own))]], s] = True
    got = {(r.split, r.arm): r.accuracy for r in G.paired_splits(rows, splits, NAMES, "gold", "score", "row_id", ["c"], own_scale).collect()}
    assert len(got) == 20
    for s in range(5):
        for arm, want in plain_paired(x, y, scores, trains[:, s], ["c"], own_scale).items():
            assert abs(got[s, arm] - want) < 1e-12, (s, arm)
    assert G.paired_splits(rows.where("gold"), 5, NAMES, "gold", "score", "row_id", []).count() == 0
