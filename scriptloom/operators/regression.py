"""Logistic regression beside a classifier: leave-one-out and paired splits.

Models are fitted by Newton steps whose matrices are sums over rows: tasks add up
their own rows, sums are added on the way, and the driver solves systems as wide
as there are features.  Models of many splits and folds are columns of the same
products, so a step of all of them is one pass over the rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple, Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.workspace import write_table
from .comparison import spread, verdict
from .holdout import best_cuts, ends
from .metrics import mcnemar, roc_auc, wilson
from .script_features import COUNTS
from .splits import stratified_halves, sums_by_key

#: Seeded splits are drawn from ids on the driver; splits by hash have no limit.
MAX_ROWS = 20_000
#: Rows that a task multiplies at a time, and folds that one pass refits.
ROWS, FOLDS = 2048, 256
#: What a leave-one-out prediction may be off (in the logit) by what the expansion leaves out.
SETTLED = 1e-8
#: A refit starts at what the expansion says if the logit is off by no more than this.
NEAR = 0.1

#: The 32 numeric features of a script that a regression may read (what is derived from points is not among them).
FEATURES = ("loc_code", *[c for c in COUNTS if c not in ("truly_correlated_count", "graph_max_scope_degree", "unresolved_predicates")], "source_tables", "graph_nodes", "graph_density", "n_nonportable_markers")

# The features that each question's label is computed from.
LEAKY = {
    "has_subquery": ("subquery_count", "scalar_subquery_count", "correlated_subquery_count", "derived_table_count", "scope_count", "max_nesting_depth"),
    "has_window_function": ("window_function_count", "distinct_window_specs"),
    "multi_source": (
        "source_tables", "graph_nodes", "table_references", "graph_edges", "graph_max_scope_sources", "graph_max_degree", "graph_density", "graph_components", "graph_max_scope_edges",
        "implicit_joins", "explicit_joins", "cross_join_risk",
    ),
    "needs_human_review": (),
}


def with_marker_count(features: DataFrame) -> DataFrame:
    """``features`` with the number of their markers, the last of ``FEATURES``."""
    return features.withColumn("n_nonportable_markers", F.size(F.coalesce("nonportable_markers", F.array().cast("array<string>"))))


def standardise(x: np.ndarray) -> np.ndarray:
    """Columns less their mean over their population deviation (constant columns: 0)."""
    deviation = x.std(axis=0)
    return (x - x.mean(axis=0)) / np.where(deviation == 0, 1.0, deviation)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def fit_logistic(x: np.ndarray, y: np.ndarray, l2: float = 1.0, rounds: int = 25, tolerance: float = 1e-8) -> np.ndarray:
    """Intercept and coefficients of a ridge-penalised model (the intercept is free), by Newton steps."""
    a = np.column_stack([np.ones(len(x)), x])
    ridge = np.full(a.shape[1], l2)
    ridge[0] = 0
    beta = np.zeros(a.shape[1])
    for _ in range(rounds):
        p = _sigmoid(a @ beta)
        curvature = np.maximum(p * (1 - p), 1e-9)
        system = a.T @ (a * curvature[:, None]) + np.diag(ridge)
        slope = a.T @ (p - y) + ridge * beta
        move = np.linalg.lstsq(system, slope, rcond=None)[0]
        beta = beta - move
        if np.abs(move).max() < tolerance:
            break
    return beta


def predict_logistic(beta: np.ndarray, x: np.ndarray) -> np.ndarray:
    return _sigmoid(beta[0] + x @ beta[1:])


def labelled_groups(rows: DataFrame, label: str, row_id: str) -> list[list]:
    """Ids of the true and of the false rows, in order: what seeded splits are drawn from."""
    table = rows.where(F.col(label).isNotNull()).select(F.col(row_id).alias("i"), F.col(label).alias("y")).orderBy("i").limit(MAX_ROWS + 1).collect()
    if len(table) > MAX_ROWS:
        raise ValueError(f"more than {MAX_ROWS} rows: seeded splits are for corpora of scripts, hash_splits for any size")
    return [[r["i"] for r in table if bool(r["y"]) is g] for g in (True, False)]


# -- Sums over rows ---------------------------------------------------------------


class Members(Protocol):
    """Which rows train in which of several models."""

    splits: int

    def trains(self, group: np.ndarray, cls: np.ndarray, ids: np.ndarray) -> np.ndarray: ...


class Everyone(NamedTuple):
    """One model of all rows."""

    splits: int = 1

    def trains(self, group: np.ndarray, cls: np.ndarray, ids: np.ndarray) -> np.ndarray:
        return np.ones((len(ids), 1), bool)


class Without(NamedTuple):
    """A model for each of ``rows``, of all other rows."""

    rows: np.ndarray

    @property
    def splits(self) -> int:
        return len(self.rows)

    def trains(self, group: np.ndarray, cls: np.ndarray, ids: np.ndarray) -> np.ndarray:
        return ids[:, None] != self.rows


class Given(NamedTuple):
    """Splits as they were drawn: the ids that train in each, by id."""

    splits: int
    of: dict[int, np.ndarray]

    def trains(self, group: np.ndarray, cls: np.ndarray, ids: np.ndarray) -> np.ndarray:
        return np.stack([self.of[int(i)] for i in ids]) if len(ids) else np.zeros((0, self.splits), bool)


class Design(NamedTuple):
    """``table`` (row, id, c, y, x): labelled rows with a number each; the sums that scale ``x``; rows and positives."""

    table: DataFrame | None
    features: list[str]
    mean: np.ndarray
    deviation: np.ndarray
    n: int
    positives: int

    def scaled(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) / self.deviation

    def detached(self) -> Design:
        """What tasks need of it."""
        return self._replace(table=None)


def design(rows: DataFrame, features: list[str], label: str, row_id: str, extra: str | None = None) -> Design:
    """The rows with a label (boolean or 0 and 1), their features as doubles (null: 0), and their means and deviations.

    ``extra`` is a column that stays, as ``extra``.  Constant features have deviation 1, so they are 0 when scaled.
    """
    x = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in features])
    used = rows.where(F.col(label).isNotNull()).select(
        F.monotonically_increasing_id().alias("row"), F.col(row_id).cast("long").alias("id"), F.col(label).cast("int").alias("c"), F.col(label).cast("double").alias("y"), x.alias("x"),
        *([F.col(extra).cast("double").alias("extra")] if extra else []),
    )
    table = write_table(used, "design")
    sums = [f(F.get("x", F.lit(i))).alias(f"{name}{i}") for i in range(len(features)) for name, f in (("m", F.avg), ("d", F.stddev_pop))]
    r = table.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("y"), F.lit(0.0)).alias("p"), *sums).first()
    mean, deviation = (np.array([r[f"{name}{i}"] or 0.0 for i in range(len(features))]) for name in "md")
    return Design(table, list(features), mean, np.where(deviation == 0, 1.0, deviation), r["n"], int(r["p"]))


def _parts(batches: Iterator[pa.RecordBatch], data: Design) -> Iterator[tuple[dict[str, np.ndarray], np.ndarray]]:
    """Columns and scaled features with a leading 1 of ``ROWS`` rows at most."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            x = part.column("x").flatten().to_numpy().reshape(part.num_rows, -1) if data.features else np.zeros((part.num_rows, 0))
            columns = {c: part.column(c).to_numpy(zero_copy_only=False) for c in part.schema.names if c != "x"}
            yield columns, np.column_stack([np.ones(part.num_rows), data.scaled(x)])


def _trains(members: Members, columns: dict[str, np.ndarray], by_row: bool) -> np.ndarray:
    ids = columns["row" if by_row else "id"]
    return members.trains(np.zeros(len(ids), np.int64), columns["c"], ids).astype(float)


def newton_sums(data: Design, members: Members, arms: dict[str, list[int]], betas: dict[str, np.ndarray], by_row: bool = False) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """For each arm (places of its features) the matrices and slopes of all its models, without the penalty, in one pass.

    ``betas`` has models by coefficients; ``by_row`` says that members are told by row numbers, not ids.
    """
    spark = data.table.sparkSession
    own, known = data.detached(), spark.sparkContext.broadcast((members, betas))
    columns = {a: np.r_[0, np.array(places, int) + 1] for a, places in arms.items()}
    upper = {a: np.triu_indices(len(c)) for a, c in columns.items()}

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        who, beta = known.value
        totals = {a: np.zeros((len(upper[a][0]) + len(c), who.splits)) for a, c in columns.items()}
        for part, wide in _parts(batches, own):
            weight = _trains(who, part, by_row)
            for a, c in columns.items():
                x = wide[:, c]
                p = _sigmoid(x @ beta[a].T)
                i, j = upper[a]
                totals[a][: len(i)] += (x[:, i] * x[:, j]).T @ (np.maximum(p * (1 - p), 1e-9) * weight)
                totals[a][len(i) :] += x.T @ ((p - part["y"][:, None]) * weight)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(totals)), pa.int64()), pa.array([t.ravel() for t in totals.values()], pa.list_(pa.float64()))], names=["key", "values"])

    # Passes of leave-one-out grow with the rows, and so do tasks: one array a pass comes to the driver, not one a task.
    sums = sums_by_key(data.table.mapInArrow(add, "key long, values array<double>"), len(arms) if members.splits > 1 else None)
    known.unpersist()
    out = {}
    for k, (a, c) in enumerate(columns.items()):
        i, j = upper[a]
        found = sums[k].reshape(-1, members.splits).T
        matrix = np.zeros((members.splits, len(c), len(c)))
        matrix[:, i, j] = matrix[:, j, i] = found[:, : len(i)]
        out[a] = matrix, found[:, len(i) :]
    return out


def _solved(matrix: np.ndarray, slope: np.ndarray) -> np.ndarray:
    try:
        return np.linalg.solve(matrix, slope[..., None])[..., 0]
    except np.linalg.LinAlgError:
        return np.stack([np.linalg.lstsq(m, s, rcond=None)[0] for m, s in zip(matrix, slope)])


def _own_scales(matrix: np.ndarray) -> np.ndarray:
    """The linear changes to features scaled over each model's rows, from the matrices of a step from zero (all rows weigh a quarter)."""
    moments = matrix * 4
    n = moments[:, :1, 0]
    mean = moments[:, 0, 1:] / n
    deviation = np.sqrt(np.maximum(np.diagonal(moments, axis1=1, axis2=2)[:, 1:] / n - mean**2, 0))
    deviation = np.where(deviation < 1e-12, 1.0, deviation)
    change = np.zeros_like(moments)
    change[:, 0, 0] = 1
    change[:, 1:, 0] = -mean / deviation
    places = np.arange(1, change.shape[1])
    change[:, places, places] = 1 / deviation
    return change


def fit_models(
    data: Design, members: Members, arms: dict[str, list[int]], start: dict[str, np.ndarray] | None = None, by_row: bool = False, own_scale: bool = False,
    l2: float = 1.0, rounds: int = 25, tolerance: float = 1e-8,
) -> dict[str, np.ndarray]:
    """Models by coefficients (the intercept first, free of the penalty) for each arm, in at most ``rounds`` passes over the rows.

    Features are scaled over all rows, or with ``own_scale`` (from zero only) over each model's rows: that is a linear
    change of the sums, made on the driver, and coefficients are given for features scaled over all rows all the same.
    """
    betas = start or {a: np.zeros((members.splits, len(c) + 1)) for a, c in arms.items()}
    change = {a: np.broadcast_to(np.eye(len(c) + 1), (members.splits, len(c) + 1, len(c) + 1)) for a, c in arms.items()}
    moving = {a: np.ones(members.splits, bool) for a in arms}
    for step in range(rounds):
        for a, (matrix, slope) in newton_sums(data, members, arms, betas, by_row).items():
            if own_scale and step == 0:
                change[a] = _own_scales(matrix)
            ridge = np.full(matrix.shape[1], l2)
            ridge[0] = 0
            turn = change[a]
            beta = np.linalg.solve(np.swapaxes(turn, 1, 2), betas[a][..., None])[..., 0]
            slope = (turn @ slope[..., None])[..., 0] + ridge * beta
            move = _solved(turn @ matrix @ np.swapaxes(turn, 1, 2) + np.diag(ridge), slope)
            betas[a] = np.where(moving[a][:, None], ((beta - move)[:, None, :] @ turn)[:, 0], betas[a])
            moving[a] = moving[a] & (np.abs(move).max(axis=1) >= tolerance)
        if not any(m.any() for m in moving.values()):
            break
    return betas


def _kept(features: list[str], variants: dict[str, list[str]]) -> dict[str, list[int]]:
    return {v: [i for i, f in enumerate(features) if f not in set(dropped)] for v, dropped in variants.items()}


def fit_table(rows: DataFrame, features: list[str], label: str, row_id: str, variants: dict[str, list[str]]) -> DataFrame:
    """variant, feature (``(intercept)`` first), coefficient of the model of all labelled rows, features scaled over them.

    ``variants`` name the features that each leaves out.  Without rows of both classes there is nothing.
    """
    data = design(rows, features, label, row_id)
    schema = "variant string, feature string, coefficient double"
    if not 0 < data.positives < data.n:
        return rows.sparkSession.createDataFrame([], schema)
    arms = _kept(features, variants)
    betas = fit_models(data, Everyone(), arms)
    made = [(v, f, float(b)) for v, places in arms.items() for f, b in zip(["(intercept)", *[features[i] for i in places]], betas[v][0])]
    return rows.sparkSession.createDataFrame(made, schema)


# -- Leave one out ----------------------------------------------------------------


class Expansion(NamedTuple):
    """Sums at a model of all rows: what its slope does around it, up to the second order."""

    beta: np.ndarray
    slope: np.ndarray
    inverse: np.ndarray
    matrix: np.ndarray
    third: np.ndarray
    gram: np.ndarray
    leverage: float


def _expansion(data: Design, places: list[int], beta: np.ndarray, l2: float = 1.0) -> Expansion:
    own, c = data.detached(), np.r_[0, np.array(places, int) + 1]
    k = len(c)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slope, matrix, gram, third = np.zeros(k), np.zeros((k, k)), np.zeros((k, k)), np.zeros((k * k, k))
        for part, wide in _parts(batches, own):
            x = wide[:, c]
            p = _sigmoid(x @ beta)
            w = p * (1 - p)
            slope += x.T @ (p - part["y"])
            matrix += x.T @ (x * w[:, None])
            gram += x.T @ x
            third += (x[:, :, None] * x[:, None, :]).reshape(len(x), -1).T @ (x * (w * (1 - 2 * p))[:, None])
        values = np.concatenate([slope, matrix.ravel(), gram.ravel(), third.ravel()])
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int64()), pa.array([values], pa.list_(pa.float64()))], names=["key", "values"])

    sums = sums_by_key(data.table.mapInArrow(add, "key long, values array<double>"))[0]
    ridge = np.full(k, l2)
    ridge[0] = 0
    slope, matrix, gram, third = np.split(sums, np.cumsum([k, k * k, k * k]))
    matrix = matrix.reshape(k, k) + np.diag(ridge)
    inverse = np.linalg.pinv(matrix, hermitian=True)

    def largest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = max((float(((w[:, c] @ inverse) * w[:, c]).sum(1).max()) for _, w in _parts(batches, own)), default=0.0)
        yield pa.RecordBatch.from_arrays([pa.array([top])], names=["h"])

    leverage = data.table.mapInArrow(largest, "h double").agg(F.max("h")).first()[0]
    return Expansion(beta, slope + ridge * beta, inverse, matrix, third.reshape(k, k, k), gram.reshape(k, k), leverage)


def _left_out(e: Expansion, x: np.ndarray, y: np.ndarray, rounds: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """For each row the change of the coefficients without it, and how far its own logit may be off by what the expansion leaves out.

    Newton steps with the matrix less the row's own part, a rank-one downdate of its inverse.
    """
    u = x @ e.inverse
    h = (u * x).sum(1)
    delta = np.zeros_like(x)
    p = _sigmoid(x @ e.beta)
    own = p * (1 - p)
    last = np.full(len(x), np.inf)
    for _ in range(rounds):
        p = _sigmoid(x @ e.beta + (x * delta).sum(1))
        second = np.einsum("abc,mb,mc->ma", e.third, delta, delta, optimize=True)
        slope = e.slope + delta @ e.matrix + second / 2 - x * (p - y)[:, None]
        v = slope @ e.inverse
        step = v + u * (own * (x * v).sum(1) / np.maximum(1 - own * h, 1e-6))[:, None]
        delta = delta - step
        last = np.abs(step).max(axis=1)
        if last.max(initial=0) < 1e-12 or not np.isfinite(last).all():
            break
    # What is left out, sum_j f(.) (x_j d)^3 x_j / 6 with |f| <= 1/8, as the row's own logit sees it, by Cauchy-Schwarz.
    in_matrix, in_gram = (np.maximum(np.einsum("ma,ab,mb->m", delta, m, delta), 0) for m in (e.matrix, e.gram))
    inner = h / np.maximum(1 - own * h, 1e-6)
    with np.errstate(over="ignore", invalid="ignore"):
        off = np.sqrt(inner * e.leverage) * np.sqrt(e.leverage * in_matrix) * in_gram / 48
    return delta, np.where(np.isfinite(off) & (last < 1e-9), off, np.inf)


LEFT_OUT = "variant string, row long, row_id long, gold boolean, p double, settled boolean"


def leave_one_out(rows: DataFrame, features: list[str], label: str, row_id: str, variants: dict[str, list[str]], least: int = 10) -> DataFrame:
    """variant, row_id, gold, p of each row, from a model that never saw it, for each variant's set of dropped features.

    A fold differs from the model of all rows by one row: from sums of the first three orders at that model each row
    finds its own fold's coefficients by itself, and bounds what is left out.  Rows that the bound doesn't settle (few
    in a large table, most in one of hundreds of rows) have their folds refitted, ``FOLDS`` in each pass over the rows.
    Under ``least`` rows or with one class there is nothing.  A fold whose training rows are of one class predicts
    that class.  Rows that repeat an id are rows of their own.
    """
    spark = rows.sparkSession
    data = design(rows, features, label, row_id)
    if data.n < least or not 0 < data.positives < data.n:
        return spark.createDataFrame([], "variant string, row_id long, gold boolean, p double")
    arms = _kept(features, variants)
    betas = fit_models(data, Everyone(), arms)
    own = data.detached()
    expanded = {v: (_expansion(data, places, betas[v][0]), np.r_[0, np.array(places, int) + 1]) for v, places in arms.items()}
    known = spark.sparkContext.broadcast(expanded)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, wide in _parts(batches, own):
            gold = part["y"] == 1
            for v, (e, c) in known.value.items():
                x = wide[:, c]
                delta, off = _left_out(e, x, part["y"])
                p = _sigmoid(x @ e.beta + (x * delta).sum(1))
                # The last row of its class leaves one class to learn from.
                lone = np.where(gold, own.positives, own.n - own.positives) == 1
                p, settled = np.where(lone, 1.0 - part["y"], p), lone | (off < SETTLED)
                columns = [pa.array([v] * len(x)), pa.array(part["row"]), pa.array(part["id"], from_pandas=True).cast(pa.int64()), pa.array(gold), pa.array(p), pa.array(settled)]
                yield pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in LEFT_OUT.split(", ")])

    found = write_table(data.table.mapInArrow(predict, LEFT_OUT), "left-out")
    parts = [found.where("settled")]
    for v, places in arms.items():
        last = -1
        while True:
            some = found.where((F.col("variant") == v) & ~F.col("settled") & (F.col("row") > last)).orderBy("row").limit(FOLDS)
            taken = data.table.join(F.broadcast(some.select("row", "gold")), "row").select("row", "id", "gold", "x").orderBy("row").collect()
            if not taken:
                break
            last = taken[-1]["row"]
            folds = Without(np.array([r["row"] for r in taken]))
            x = data.scaled(np.array([r["x"] for r in taken]).reshape(len(taken), -1))[:, places]
            # What the expansion says is near: steps from there are fewer than from the model of all rows.
            delta, off = _left_out(expanded[v][0], np.column_stack([np.ones(len(x)), x]), np.array([float(r["gold"]) for r in taken]))
            start = betas[v][0] + np.where((off < NEAR)[:, None], delta, 0.0)
            beta = fit_models(data, folds, {v: places}, {v: start}, by_row=True)[v]
            p = _sigmoid(beta[:, 0] + (x * beta[:, 1:]).sum(1))
            made = [(v, r["row"], r["id"], r["gold"], float(q), True) for r, q in zip(taken, p)]
            parts.append(write_table(spark.createDataFrame(made, LEFT_OUT).coalesce(1), "refitted"))
    result = parts[0]
    for part in parts[1:]:
        result = result.union(part)
    return result.select("variant", "row_id", "gold", "p")


def baseline(rows: DataFrame, features: list[str], label: str, row_id: str, leaky: list[str], score: str) -> DataFrame:
    """variant, n, n_features, accuracy with its Wilson interval (low, high) and auc of the leave-one-out regression with all
    features and without those that define the label (``clean``); classifier_accuracy, classifier_auc and McNemar's b (only
    the classifier right), c (only the regression) and p against the classifier's ``score``, null unless every labelled row has one.

    Ids are distinct.  Nothing under 10 rows or with one class.
    """
    variants = {"leaky": [], "clean": leaky}
    left = leave_one_out(rows, features, label, row_id, variants)
    own = rows.where(F.col(label).isNotNull()).select(F.col(row_id).cast("long").alias("_id"), F.col(score).cast("double").alias("own"))
    both = left.join(own, left["row_id"] == own["_id"]).select("variant", F.col("gold").alias("gold_bool"), "p", "own")
    judged = write_table(both.withColumn("lr_right", (F.col("p") >= 0.5) == F.col("gold_bool")).withColumn("right", F.coalesce((F.col("own") >= 0.5) == F.col("gold_bool"), F.lit(False))), "baseline")
    base = judged.groupBy("variant").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("lr_right").alias("hits"), F.count_if("right").alias("own_hits"), (F.count("own") == F.count(F.lit(1))).alias("complete"),
    )
    low, high = wilson(F.col("hits"), F.col("n"))
    auc = lambda c, name: roc_auc(judged.select("variant", "gold_bool", F.col(c).alias("score")).where("score IS NOT NULL"), ["variant"]).select("variant", F.col("auc").alias(name))
    out = base.join(auc("p", "auc"), "variant").join(auc("own", "_own_auc"), "variant", "left").join(mcnemar(judged, ["variant"], "right", "lr_right").withColumnRenamed("p", "_p"), "variant")
    size = F.when(F.col("variant") == "clean", len([f for f in features if f not in set(leaky)])).otherwise(len(features)).cast("long")
    known = lambda c: F.when(F.col("complete"), c)
    return out.select(
        "variant", "n", size.alias("n_features"), (F.col("hits") / F.col("n")).alias("accuracy"), low.alias("low"), high.alias("high"), "auc",
        known(F.col("own_hits") / F.col("n")).alias("classifier_accuracy"), known(F.col("_own_auc")).alias("classifier_auc"), known(F.col("b")).alias("b"), known(F.col("c")).alias("c"), known(F.col("_p")).alias("p"),
    )


# -- Paired splits ----------------------------------------------------------------


def given_splits(split_table: DataFrame) -> Given:
    """Seeded splits (split, row_id, is_train), which were drawn on the driver, by id."""
    table = split_table.toPandas()
    splits = int(table["split"].max()) + 1 if len(table) else 0
    of = {int(i): np.zeros(splits, bool) for i in table["row_id"].unique()}
    for s, i, t in zip(table["split"], table["row_id"], table["is_train"]):
        of[int(i)][s] = t
    return Given(splits, of)


def paired_splits(rows: DataFrame, splits: int | DataFrame, features: list[str], label: str, score: str, row_id: str, leaky: list[str], train_only_scaling: bool = False) -> DataFrame:
    """split, arm, accuracy on test rows: the classifier's score with a fitted cut, regressions without and with the
    label-defining features, and the majority class (true on a tie).

    ``splits`` is how many stratified halves are taken, for any number of rows, or a table of seeded ones (split, row_id,
    is_train) that has every labelled row.  Rows without label, score or id are left out, ids are distinct; under 12
    rows or 4 of a class there is nothing.  Features are scaled over all rows, or over training rows only on demand.
    Every Newton step of every split and both regressions is one pass over the rows.
    """
    spark = rows.sparkSession
    schema = "split long, arm string, accuracy double"
    used = rows.where(F.col(label).isNotNull() & F.col(score).isNotNull() & F.col(row_id).isNotNull())
    data = design(used, features, label, row_id, score)
    if data.n < 12 or min(data.positives, data.n - data.positives) < 4:
        return spark.createDataFrame([], schema)
    members: Members = given_splits(splits) if isinstance(splits, DataFrame) else stratified_halves(data.table, [], "c", "id", splits)[1]
    # A cut is tried at each training score to four digits and at 1/2, and counts raw scores.
    event = lambda v, kind: F.struct(v.alias("_v"), kind.cast("byte").alias("_kind"))
    both = F.explode(F.array(event(F.col("extra"), F.col("c")), event(F.rint(F.col("extra") * 10000) / 10000, F.lit(2 + 4))))
    events = data.table.select(F.lit(0).alias("_g"), F.col("c").alias("_c"), F.col("id").alias("_i"), both.alias("e")).select("_g", "_c", "_i", "e._v", "e._kind")
    cuts = best_cuts(events.union(ends(spark, 1, (0.5,))), members)
    classifier = cuts.where("n_test > 0 AND n_train > 0").select("split", F.lit("classifier").alias("arm"), (F.col("first.right") / F.col("n_test")).alias("accuracy"))
    arms = _kept(features, {"lr_clean": leaky, "lr_leaky": []})
    found = _test_hits(data, members, arms, fit_models(data, members, arms, own_scale=train_only_scaling))
    made = [(s, a, float(right[s] / tests[s])) for a, (right, tests) in found.items() for s in range(members.splits) if 0 < tests[s] < data.n]
    return classifier.union(spark.createDataFrame(made, schema))


def _test_hits(data: Design, members: Members, arms: dict[str, list[int]], betas: dict[str, np.ndarray]) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Of each arm and the majority class: rows that don't train and are called right, and rows that don't train, by split."""
    own, known = data.detached(), data.table.sparkSession.sparkContext.broadcast((members, betas))
    columns = {a: np.r_[0, np.array(places, int) + 1] for a, places in arms.items()}

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        who, beta = known.value
        totals = np.zeros((len(columns) + 4, who.splits), np.int64)
        for part, wide in _parts(batches, own):
            trains = _trains(who, part, False) > 0
            gold = (part["y"] == 1)[:, None]
            for k, (a, c) in enumerate(columns.items()):
                totals[k] += (((_sigmoid(wide[:, c] @ beta[a].T) >= 0.5) == gold) & ~trains).sum(0)
            totals[-4:] += np.stack([(t & g).sum(0) for t in (trains, ~trains) for g in (gold, ~gold)])
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int64()), pa.array([totals.ravel()], pa.list_(pa.int64()))], names=["key", "values"])

    sums = sums_by_key(data.table.mapInArrow(add, "key long, values array<long>"))[0].reshape(-1, members.splits)
    yes, no, test_yes, test_no = sums[-4:]
    tests = test_yes + test_no
    return {**{a: (sums[k], tests) for k, a in enumerate(columns)}, "majority": (np.where(yes >= no, test_yes, test_no), tests)}


def paired_summary(arms: DataFrame) -> DataFrame:
    """measure, arm, n, mean, p05, p95, win_rate, verdict: each arm's accuracy, and the classifier's lead over each other arm."""
    own = spread(arms, "accuracy", ["arm"]).select(F.lit("accuracy").alias("measure"), "arm", "n", "mean", "p05", "p95", F.lit(None).cast("double").alias("win_rate"), F.lit(None).cast("string").alias("verdict"))
    base = arms.where("arm = 'classifier'").select("split", F.col("accuracy").alias("own"))
    leads = arms.where("arm <> 'classifier'").join(base, "split").withColumn("lead", F.col("own") - F.col("accuracy"))
    wins = leads.groupBy("arm").agg(F.avg((F.col("lead") > 0).cast("double")).alias("win_rate"))
    other = spread(leads, "lead", ["arm"]).join(wins, "arm").withColumn("verdict", verdict(F.col("p05"), F.col("p95")))
    return own.union(other.select(F.lit("lead").alias("measure"), "arm", "n", "mean", "p05", "p95", "win_rate", "verdict"))
