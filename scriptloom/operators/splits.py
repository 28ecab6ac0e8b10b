"""Stratified splits of any number of rows, many at a time.

A row's place in a split is a hash of its id and the split.  Of each class, the
rows of the least hashes train: so many that counts are exact, not only expected.
Where the last of them lies is found for all splits at once by histograms that
narrow around it, so no rows are sorted, and what a task needs to know to place a
row in 500 splits is 500 numbers a class.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.workspace import shuffle_partitions, write_table

_ODD, _STEP, _MIX1, _MIX2 = 0xD1342543DE82EF95, 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
#: Parts that an interval is narrowed by in a round, and rows left in one when they are listed.
BINS, FEW = 64, 64
#: Rows whose hashes a task holds at a time.
CHUNK = 2048


def split_hashes(ids: np.ndarray, splits: int) -> np.ndarray:
    """Hashes (64 bits, unsigned) of each id with each of ``splits`` splits."""
    with np.errstate(over="ignore"):
        x = (ids.astype(np.int64).view(np.uint64) * np.uint64(_ODD))[:, None] + np.arange(1, splits + 1, dtype=np.uint64) * np.uint64(_STEP)
        x ^= x >> np.uint64(30)
        x *= np.uint64(_MIX1)
        x ^= x >> np.uint64(27)
        x *= np.uint64(_MIX2)
        x ^= x >> np.uint64(31)
    return x


def split_hash_sql(row_id: str, split: str) -> str:
    """The same as DuckDB SQL."""
    times = lambda x, c: f"CAST((CAST({x} AS UHUGEINT) * CAST({c} AS UHUGEINT)) % 18446744073709551616 AS UBIGINT)"
    shifted = lambda x, n: f"xor({x}, {x} >> {n})"
    unsigned = f"CAST((CAST({row_id} AS HUGEINT) + 18446744073709551616) % 18446744073709551616 AS UBIGINT)"
    x = f"CAST((CAST({times(unsigned, _ODD)} AS UHUGEINT) + CAST({times(f'({split} + 1)', _STEP)} AS UHUGEINT)) % 18446744073709551616 AS UBIGINT)"
    return f"list_transform([{x}], lambda x: list_transform([{times(shifted('x', 30), _MIX1)}], lambda y: list_transform([{times(shifted('y', 27), _MIX2)}], lambda z: {shifted('z', 31)})[1])[1])[1]"


def half(n: int, fraction: float = 0.5, least: int = 2) -> int:
    """Rows of a class of ``n`` that train: the share, rounded half to even, but ``least`` at least (and all at most)."""
    return min(n, max(least, round(n * fraction)))


class Halves(NamedTuple):
    """Of each (group, class): how many rows it has, and for each split hash and id of the last row that trains."""

    splits: int
    groups: list[tuple]
    sizes: dict[tuple[int, int], int]
    cuts: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]]

    def trains(self, group: np.ndarray, cls: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Whether each row trains in each split."""
        h = split_hashes(ids, self.splits)
        out = np.empty(h.shape, bool)
        for g, c in set(zip(group.tolist(), cls.tolist())):
            own = np.flatnonzero((group == g) & (cls == c))
            hash_, last = self.cuts[g, c]
            out[own] = (h[own] < hash_) | (h[own] == hash_) & (ids[own][:, None] <= last)
        return out


def summed(df: DataFrame, keys: int | None = None) -> DataFrame:
    """key, values (an array) of one size a key: the sums over all rows of each key, in two steps so that none meets more than its share.

    ``keys`` says how many there are at most, if they are few: no more tasks answer then, and the rows of up to ``DIRECT`` tasks are added in one step.
    """

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        kind = None
        for batch in batches:
            kind = batch.schema.field("values").type
            for key, row in zip(batch.column("key").to_pylist(), batch.column("values")):
                own = row.values.to_numpy(zero_copy_only=False)
                totals[key] = totals[key] + own if key in totals else own
        if totals:
            yield pa.RecordBatch.from_arrays([pa.array(list(totals), pa.int64()), pa.array(list(totals.values()), kind)], names=["key", "values"])

    n = shuffle_partitions(df.sparkSession)
    kind = df.schema["values"].dataType.simpleString()
    last = min(n, keys) if keys else n
    some = df
    if not keys or df.rdd.getNumPartitions() > DIRECT:
        lanes = min(n, 16 * keys) if keys else n
        some = df.withColumn("_lane", F.spark_partition_id() % 16).repartition(lanes, "key", "_lane").select("key", "values").mapInArrow(add, f"key long, values {kind}")
    return some.repartition(last, "key").mapInArrow(add, f"key long, values {kind}")


#: Tasks whose arrays the driver adds up itself; those of more are added on the way.
DIRECT = 32


def sums_by_key(df: DataFrame, keys: int | None = None) -> dict[int, np.ndarray]:
    """The sums of ``summed`` on the driver: as many arrays as there are keys, or at most ``DIRECT`` times as many on the way
    if ``keys`` (how many there are at most) isn't given.

    ``df`` reads a stored table: no exchange lies before it.
    """
    few = df.rdd.getNumPartitions() <= (1 if keys else DIRECT)
    table = (df if few else summed(df, keys)).toArrow()
    out: dict[int, np.ndarray] = {}
    for k, v in zip(table.column("key").to_pylist(), table.column("values")):
        own = v.values.to_numpy()
        out[k] = out[k] + own if k in out else own
    return out


def same(by: list[str], others: list[str]) -> Column:
    """That columns ``by`` equal columns ``others``, nulls like any value."""
    on = F.lit(True)
    for c, o in zip(by, others):
        on = on & F.col(c).eqNullSafe(F.col(o))
    return on


def numbered(df: DataFrame, by: list[str], keys: list[tuple]) -> DataFrame:
    """``df`` with ``_g``, the place of its values of ``by`` among ``keys``; rows of others go."""
    if not by:
        return df.withColumn("_g", F.lit(0)) if keys else df.withColumn("_g", F.lit(0)).where("false")
    spark = df.sparkSession
    kinds = ", ".join(f"_by{i} {df.schema[c].dataType.simpleString()}" for i, c in enumerate(by))
    codes = spark.createDataFrame([(*k, i) for i, k in enumerate(keys)], f"{kinds}, _g int")
    # One row for each value of ``by``.
    return df.join(F.broadcast(codes), same(by, [f"_by{i}" for i in range(len(by))])).drop(*[f"_by{i}" for i in range(len(by))])


def stratified_halves(df: DataFrame, by: list[str], cls: str, row_id: str, splits: int, fraction: float = 0.5, least_rows: int = 1, classes: int = 2) -> tuple[DataFrame, Halves]:
    """``df`` with ``_g`` and ``_c`` (numbers of its group and class), and the halves of each class of each group.

    ``cls`` is a column of whole numbers from 0 below ``classes`` (a boolean: 0 and 1); rows where it or ``row_id`` (whole numbers,
    distinct within a group) is null go, and so do groups that have fewer than ``least_rows`` rows of a class.
    Rows that repeat an id share their place; then a class may train more than its half.

    The driver holds a number for each group, class and split.
    """
    rows = df.where(F.col(cls).isNotNull() & F.col(row_id).isNotNull()).withColumn("_c", F.col(cls).cast("int"))
    found: dict[tuple, dict[int, int]] = {}
    for r in rows.groupBy(*by, "_c").agg(F.count(F.lit(1)).alias("_n")).collect():
        found.setdefault(tuple(r[c] for c in by), {})[r["_c"]] = r["_n"]
    keys = sorted((k for k, n in found.items() if min(n.get(c, 0) for c in range(classes)) >= least_rows), key=lambda k: [(x is not None, x) for x in k])
    sizes = {(g, c): n for g, k in enumerate(keys) for c, n in found[k].items()}
    rows = numbered(rows, by, keys)
    ids = write_table(rows.select("_g", "_c", F.col(row_id).cast("long").alias("id")), "ids")
    return rows, Halves(splits, keys, sizes, _cuts(ids, {k: half(n, fraction) for k, n in sizes.items()}, sizes, splits))


def _cuts(ids: DataFrame, wanted: dict[tuple[int, int], int], sizes: dict[tuple[int, int], int], splits: int) -> dict[tuple[int, int], tuple[np.ndarray, np.ndarray]]:
    """Hash and id of the ``wanted``-th row of each (group, class), for each split, in the order of both."""
    send = ids.sparkSession.sparkContext.broadcast
    low = {k: np.zeros(splits, np.uint64) for k in wanted}
    high = {k: np.full(splits, 2**64 - 1, np.uint64) for k in wanted}  # the last value inside
    below = {k: np.zeros(splits, np.int64) for k in wanted}
    left = dict(sizes)
    # Hashes spread evenly: the first guess is where the wanted share ends, by eight deviations to each side.
    for k, n in sizes.items():
        share, spread = wanted[k] / n, 8 * np.sqrt(n) / n
        low[k][:] = np.uint64(int(max(0.0, share - spread) * (2**64 - 2**12)))
        high[k][:] = np.uint64(int(min(1.0, share + spread) * (2**64 - 2**12)) + 2**12 - 1)
    while any(n > FEW and (high[k] > low[k]).any() for k, n in left.items()):
        state = send((low, high))
        counts = sums_by_key(_histograms(ids, state, splits))
        state.unpersist()
        for k in wanted:
            table = counts[k[0] << 32 | k[1]].reshape(splits, BINS + 2)
            upto = np.cumsum(table, axis=1)
            at = (upto < wanted[k]).sum(axis=1)  # 0: below the interval; BINS + 1: above it
            inside = (at > 0) & (at <= BINS)
            width = (high[k] - low[k]) // np.uint64(BINS) + np.uint64(1)
            with np.errstate(over="ignore"):
                start = low[k] + width * (np.maximum(at, 1) - 1).astype(np.uint64)
                end = np.minimum(high[k], start + (width - np.uint64(1)))
            end = np.where(end < start, high[k], end)
            # A guess that missed gives way to all that lies beyond it.
            new_low = np.where(inside, start, np.where(at == 0, np.uint64(0), high[k] + np.uint64(1)))
            new_high = np.where(inside, end, np.where(at == 0, low[k] - np.uint64(1), np.uint64(2**64 - 1)))
            line = np.arange(splits)
            below[k] = np.where(at > 0, upto[line, np.maximum(at, 1) - 1], 0)
            left[k] = int(table[line, at].max())
            low[k], high[k] = new_low, new_high
    state = send((low, high))
    near = _listed(ids, state, splits).groupBy("g", "c", "split", "h", "id").agg(F.count(F.lit(1)).alias("n"))
    cuts = {k: (np.zeros(splits, np.uint64), np.zeros(splits, np.int64)) for k in wanted}
    table = near.toArrow().sort_by([("g", "ascending"), ("c", "ascending"), ("split", "ascending"), ("h", "ascending"), ("id", "ascending")])
    state.unpersist()
    g, c, s, h, i, n = (table.column(x).to_numpy() for x in ("g", "c", "split", "h", "id", "n"))
    first = np.flatnonzero(np.r_[True, (g[1:] != g[:-1]) | (c[1:] != c[:-1]) | (s[1:] != s[:-1])]) if len(g) else []
    for a, b in zip(first, [*first[1:], len(g)]):
        k = (int(g[a]), int(c[a]))
        at = a + int(np.searchsorted(np.cumsum(n[a:b]), wanted[k] - below[k][s[a]]))
        cuts[k][0][s[a]], cuts[k][1][s[a]] = np.uint64(int(h[at]) + 2**63), i[at]
    return cuts


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int], np.ndarray]]:
    """Rows of one (group, class), ``CHUNK`` at most at a time."""
    for batch in batches:
        g, c, ids = (batch.column(x).to_numpy() for x in ("_g", "_c", "id"))
        for k in sorted(set(zip(g.tolist(), c.tolist()))):
            own = ids[(g == k[0]) & (c == k[1])]
            for at in range(0, len(own), CHUNK):
                yield k, own[at : at + CHUNK]


def _histograms(ids: DataFrame, state: Broadcast, splits: int) -> DataFrame:
    """key, values: of each (group, class) and split the rows below the interval, in each of its ``BINS`` parts, and above."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, high = state.value
        totals: dict[tuple[int, int], np.ndarray] = {}
        line = np.arange(splits) * (BINS + 2)
        for k, own in _chunks(batches):
            h = split_hashes(own, splits)
            place = np.where(h < low[k], 0, BINS + 1)
            row, col = np.nonzero((h >= low[k]) & (h <= high[k]))
            width = (high[k] - low[k]) // np.uint64(BINS) + np.uint64(1)
            place[row, col] = 1 + ((h[row, col] - low[k][col]) // width[col]).astype(np.int64)
            counts = np.bincount((place + line).ravel(), minlength=splits * (BINS + 2))
            totals[k] = totals[k] + counts if k in totals else counts
        if totals:
            yield pa.RecordBatch.from_arrays([pa.array([g << 32 | c for g, c in totals], pa.int64()), pa.array(list(totals.values()), pa.list_(pa.int64()))], names=["key", "values"])

    return ids.mapInArrow(count, "key long, values array<long>")


def _listed(ids: DataFrame, state: Broadcast, splits: int) -> DataFrame:
    """g, c, split, h (less 2**63), id of the rows within the intervals."""

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, high = state.value
        for k, own in _chunks(batches):
            h = split_hashes(own, splits)
            row, col = np.nonzero((h >= low[k]) & (h <= high[k]))
            signed = (h[row, col] ^ np.uint64(1 << 63)).view(np.int64)
            fixed = [pa.array(np.full(len(row), x, np.int32)) for x in k]
            yield pa.RecordBatch.from_arrays([*fixed, pa.array(col.astype(np.int32)), pa.array(signed), pa.array(own[row])], names=["g", "c", "split", "h", "id"])

    return ids.mapInArrow(name, "g int, c int, split int, h long, id long")


def stratified_splits(df: DataFrame, by: list[str], cls: str, row_id: str, repeats: int, fraction: float = 0.5, classes: int = 2) -> DataFrame:
    """Each row once for each of a few splits, with ``split`` and ``is_train``; see ``stratified_halves`` for what goes."""
    rows, halves = stratified_halves(df, by, cls, row_id, repeats, fraction, classes=classes)
    known = df.sparkSession.sparkContext.broadcast(halves)
    kinds = rows.select("_g", "_c", F.col(row_id).cast("long").alias("_i"), F.struct(*df.columns).alias("_row"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                part = batch.slice(at, CHUNK)
                trains = known.value.trains(*[part.column(c).to_numpy() for c in ("_g", "_c", "_i")])
                flags = pa.ListArray.from_arrays(np.arange(0, trains.size + 1, trains.shape[1], dtype=np.int32), pa.array(trains.ravel()))
                yield pa.RecordBatch.from_arrays([part.column("_row"), flags], names=["_row", "_trains"])

    placed = kinds.mapInArrow(place, f"_row {kinds.schema['_row'].dataType.simpleString()}, _trains array<boolean>")
    return placed.select("_row", F.posexplode("_trains").alias("split", "is_train")).select("_row.*", F.col("split").cast("long").alias("split"), "is_train")
