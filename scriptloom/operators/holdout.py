"""Decision thresholds fitted on one half of the rows and scored on the other, for hundreds of splits in one sorted pass.

Which splits a row trains in is a bit each, packed beside its score.  Rows of one
score are added bit by bit: carry-save adders on whole words count for 64 splits
at a time.  Rows move once, sorted by score; how many splits there are changes
what tasks compute, hardly what they exchange.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.workspace import shuffle_partitions, write_table
from .splits import Halves, stratified_halves

#: Rows whose bits and scores are one row of the packed table.
BLOCK = 1 << 14
#: Scores whose counts in all splits a task holds at a time.
RUNS = 1 << 11


def packed(bits: np.ndarray) -> np.ndarray:
    """Rows of booleans as rows of 64-bit words."""
    n, s = bits.shape
    wide = np.zeros((n, -(-s // 64) * 64), bool)
    wide[:, :s] = bits
    return np.packbits(wide, axis=1, bitorder="little").view(np.uint64)


def unpacked(words: np.ndarray, splits: int) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(words).view(np.uint8), axis=1, count=splits, bitorder="little")


def run_counts(words: np.ndarray, starts: np.ndarray, splits: int) -> np.ndarray:
    """How many rows of each run (``starts``: where runs of at least one row begin) have each bit.

    Neighbours of a run are added until one number a bit is left: number k of a run's bits is in word k of its planes.
    """
    planes = words[None]
    while planes.shape[1] > len(starts):
        sizes = np.diff(np.r_[starts, planes.shape[1]])
        place = np.arange(planes.shape[1]) - np.repeat(starts, sizes)
        first = np.flatnonzero(place % 2 == 0)
        paired = np.r_[place[1:] % 2 == 1, False][first]
        a, b = planes[:, first], np.where(paired[None, :, None], planes[:, np.minimum(first + 1, planes.shape[1] - 1)], np.uint64(0))
        carry = np.zeros_like(a[0])
        total = np.empty((len(planes) + 1, *a.shape[1:]), np.uint64)
        for k, (x, y) in enumerate(zip(a, b)):
            half = x ^ y
            total[k] = half ^ carry
            carry = x & y | half & carry
        total[-1] = carry
        planes = total
        starts = np.cumsum(np.r_[0, (sizes + 1) // 2])[:-1]
    out = np.zeros((len(starts), splits), np.int64)
    for k, plane in enumerate(planes):
        out += unpacked(plane, splits).astype(np.int64) << k
    return out


PACKED = "g int, task int, v array<double>, kind array<tinyint>, words binary, before array<long>, first_run array<long>, open boolean, total array<long>, tail array<long>"


def _counted(kind: np.ndarray, words: np.ndarray, starts: np.ndarray, splits: int) -> np.ndarray:
    """Of each run of scores: training positives and negatives of each split, then all positives and all negatives."""
    out = np.zeros((len(starts), 2 * splits + 2), np.int64)
    run = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(kind)]))
    for c, at in ((1, 0), (0, splits)):
        own = np.flatnonzero(kind & 3 == c)
        if len(own):
            runs, first = np.unique(run[own], return_index=True)
            out[runs, at : at + splits] = run_counts(words[own], first, splits)
            out[:, 2 * splits + 1 - c] = np.bincount(run[own], minlength=len(starts))
    return out


def _pieces(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[int, dict[str, np.ndarray]]]:
    """Sorted rows in parts of one group and ``size`` rows at most."""
    for batch in batches:
        columns = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in batch.schema.names}
        ends = np.flatnonzero(np.diff(columns["_g"])) + 1
        for a, b in zip([0, *ends], [*ends, batch.num_rows]):
            for at in range(a, b, size):
                yield int(columns["_g"][a]), {c: v[at : min(b, at + size)] for c, v in columns.items()}


def _pack(events: DataFrame, halves: Broadcast) -> DataFrame:
    """Blocks of sorted events with their bits, the counts of the task before them and, behind the last of a task and group, its totals.

    ``kind``: class 0 or 1 (2: counts nowhere), plus 4 if the value is a candidate in the splits where the row trains,
    plus 8 if it is one in all.
    """
    splits, size = halves.value.splits, BLOCK
    n = shuffle_partitions(events.sparkSession)
    # Ids keep rows of one score apart, so that a score that most rows have spreads over tasks.
    dealt = events.repartitionByRange(n, "_g", "_v", "_i").sortWithinPartitions("_g", "_v", "_kind", "_i").withColumn("_task", F.spark_partition_id())

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, zero = None, np.zeros(2 * splits + 2, np.int64)
        task = None

        def row(values, kind, words, before, first_run, open_, total, tail):
            columns = (group, task, values, kind, words, before, first_run, open_, total, tail)
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(columns, _TYPES)], names=_NAMES)

        for g, part in _pieces(batches, size):
            if g != group:
                if group is not None:
                    yield row([first, last], None, None, None, None, one_run, before, tail)
                group, task, before, tail, first, last, one_run = g, int(part["_task"][0]), zero, zero, part["_v"][0], None, True
            v, kind = part["_v"], part["_kind"]
            bits = np.zeros((len(v), splits), bool)
            counts = kind & 3 < 2
            own = np.flatnonzero(counts | (kind & 4 > 0))
            if len(own):
                bits[own] = halves.value.trains(part["_g"][own], part["_c"][own], part["_i"][own])
            bits[kind & 8 > 0] = True
            words = packed(bits)
            starts = np.flatnonzero(np.r_[True, v[1:] != v[:-1]])
            goes_on = last is not None and v[0] == last
            open_ = last is None or (goes_on and one_run)
            yield row(v, kind, words.tobytes(), before, tail if goes_on else before, open_, None, None)
            # Counts at the start of each run, and behind the last.
            upto = before + np.cumsum(_counted(kind, words, starts, splits), axis=0)
            if len(starts) > 1:
                tail = upto[-2]
            elif not goes_on:
                tail = before
            one_run = one_run and v[-1] == first
            before, last = upto[-1], v[-1]
        if group is not None:
            yield row([first, last], None, None, None, None, one_run, before, tail)

    return dealt.mapInArrow(pack, PACKED)


_ARROW = {"int": pa.int32(), "array<double>": pa.list_(pa.float64()), "array<tinyint>": pa.list_(pa.int8()), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "boolean": pa.bool_()}
_NAMES, _TYPES = zip(*[(x.split()[0], _ARROW[x.split()[1]]) for x in PACKED.split(", ")])
BEST = "g int, split int, hits long, first_v double, first_inverted boolean, first_right long, last_v double, last_inverted boolean, last_right long, n_train long, n_test long"


def _offsets(blocks: DataFrame) -> tuple[dict[tuple[int, int], tuple[np.ndarray, np.ndarray]], dict[int, np.ndarray]]:
    """Of each task and group the counts before it and before the run of scores it starts in; of each group all counts.

    As many rows come to the driver as there are tasks and groups.
    """
    table = blocks.where("total IS NOT NULL").select("g", "task", "v", F.col("open").alias("one_run"), "total", "tail").toArrow().sort_by([("g", "ascending"), ("task", "ascending")])
    offsets, totals = {}, {}
    state = None
    for row in table.to_pylist():
        g, (first, last) = row["g"], row["v"]
        if state is None or state[0] != g:
            state = (g, np.zeros(len(row["total"]), np.int64), None, None)
        _, so_far, last_v, run_start = state
        start = run_start if last_v is not None and first == last_v else so_far
        offsets[g, row["task"]] = (so_far, start)
        tail = start if row["one_run"] else so_far + np.array(row["tail"])
        totals[g] = so_far + np.array(row["total"])
        state = (g, totals[g], last, tail)
    return offsets, totals


def _best(blocks: DataFrame, splits: int) -> DataFrame:
    """Of each block, group and split the candidates with most hits in training: the first and the last, and their hits in the test half."""
    spark = blocks.sparkSession
    known, runs = spark.sparkContext.broadcast(_offsets(blocks)), RUNS

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        offsets, totals = known.value
        for batch in batches:
            for row in batch.to_pylist():
                g, kind, v = row["g"], np.array(row["kind"], np.int8), np.array(row["v"])
                words = np.frombuffer(row["words"], np.uint64).reshape(len(v), -1)
                so_far, run_start = offsets[g, row["task"]]
                below = so_far + np.array(row["before"])
                starts = np.flatnonzero(np.r_[True, v[1:] != v[:-1]])
                for at in range(0, len(starts), runs):
                    some = starts[at : at + runs]
                    end = starts[at + runs] if at + runs < len(starts) else len(v)
                    part = slice(some[0], end)
                    counts = _counted(kind[part], words[part], some - some[0], splits)
                    upto = np.cumsum(counts, axis=0)
                    before = below + upto - counts
                    if at == 0:
                        before[0] = run_start if row["open"] else so_far + np.array(row["first_run"])
                    below = below + upto[-1]
                    yield from _ranked(g, v[some], before, totals[g], _present(kind[part], words[part], some - some[0], splits), splits)

    return blocks.where("total IS NULL").mapInArrow(search, BEST)


def _present(kind: np.ndarray, words: np.ndarray, starts: np.ndarray, splits: int) -> np.ndarray:
    """Whether each run is a candidate in each split."""
    shown = np.where((kind & 12 > 0)[:, None], words, np.uint64(0))
    return unpacked(np.bitwise_or.reduceat(shown, starts, axis=0), splits).astype(bool)


def _ranked(g: int, v: np.ndarray, before: np.ndarray, total: np.ndarray, present: np.ndarray, splits: int) -> Iterator[pa.RecordBatch]:
    pos, neg = before[:, :splits], before[:, splits : 2 * splits]
    n_train = total[:splits] + total[splits : 2 * splits]
    n_test = total[2 * splits :].sum() - n_train
    hits = total[:splits] - pos + neg
    right = total[2 * splits] - total[:splits] - (before[:, [2 * splits]] - pos) + before[:, [2 * splits + 1]] - neg
    ways = np.where(present[:, None], np.stack([hits, n_train - hits], axis=1), -1).reshape(-1, splits)
    tested = np.stack([right, n_test - right], axis=1).reshape(-1, splits)
    line = np.arange(splits)
    first, last = ways.argmax(axis=0), len(ways) - 1 - ways[::-1].argmax(axis=0)
    keep = np.flatnonzero(ways[first, line] >= 0)
    if len(keep):
        columns = [np.full(splits, g, np.int32), line.astype(np.int32), ways[first, line]]
        for at in (first, last):
            columns += [v[at // 2], at % 2 == 1, tested[at, line]]
        yield pa.RecordBatch.from_arrays([pa.array(c[keep]) for c in (*columns, n_train, n_test)], names=[x.split()[0] for x in BEST.split(", ")])


def best_cuts(events: DataFrame, halves: Halves) -> DataFrame:
    """_g, split, hits, n_train, n_test and, of the ``first`` and the ``last`` best candidate (by threshold, then not
    inverted before inverted): ``threshold``, ``inverted`` and ``right``, its hits among the rows that don't train.

    ``events`` (_g, _c, _i, _v, _kind) are the rows of ``stratified_halves`` with a score and a kind (see ``_pack``).
    """
    spark = events.sparkSession
    blocks = write_table(_pack(events, spark.sparkContext.broadcast(halves)), "blocks")
    found = _best(blocks, halves.splits)
    first = F.max(F.struct("hits", (-F.col("first_v")).alias("v"), (~F.col("first_inverted")).alias("way"), F.col("first_right").alias("right")))
    last = F.max(F.struct("hits", F.col("last_v").alias("v"), F.col("last_inverted").alias("way"), F.col("last_right").alias("right")))
    best = found.groupBy(F.col("g").alias("_g"), "split").agg(first.alias("f"), last.alias("l"), F.max("n_train").alias("n_train"), F.max("n_test").alias("n_test"))
    pick = lambda v, inverted, right: F.struct(v.alias("threshold"), inverted.alias("inverted"), right.alias("right"))
    return best.select(
        "_g", F.col("split").cast("long").alias("split"), F.col("f.hits").alias("hits"), "n_train", "n_test",
        pick(0.0 - F.col("f.v"), ~F.col("f.way"), F.col("f.right")).alias("first"), pick(F.col("l.v"), F.col("l.way"), F.col("l.right")).alias("last"),
    )


def ends(spark: SparkSession, groups: int, values: tuple[float, ...]) -> DataFrame:
    """Candidates that every split of every group has."""
    made = [(g, 2, i, v, 2 + 8) for g in range(groups) for i, v in enumerate(values)]
    return spark.createDataFrame(made, "_g int, _c int, _i long, _v double, _kind int").withColumn("_kind", F.col("_kind").cast("byte"))


def threshold_halves(df: DataFrame, by: list[str], row_id: str, repeats: int = 500, fraction: float = 0.5, least: int = 4) -> DataFrame:
    """``by``, split, threshold, inverted, train_accuracy, test_accuracy, n_test: the cut with most hits on a stratified
    half of the rows (``gold_bool``, ``score``), scored on the others, for each of ``repeats`` splits.

    Candidates are the half's scores, 0 and 1, both polarities; ties are broken as ``metrics.best_threshold`` does.
    Rows with a null gold, score or id and NaN scores are left out, as are values of ``by`` with fewer than
    ``least`` rows of a class; nulls in ``by`` are a value.  Ids must be distinct within a value of ``by``.
    The driver holds numbers for each value of ``by`` and split, and for each task.
    """
    used = df.where("gold_bool IS NOT NULL AND score IS NOT NULL AND NOT isnan(score)")
    rows, halves = stratified_halves(used, by, "gold_bool", row_id, repeats, fraction, least)
    events = rows.select("_g", "_c", F.col(row_id).cast("long").alias("_i"), F.col("score").cast("double").alias("_v"), (F.col("_c") + 4).cast("byte").alias("_kind"))
    best = best_cuts(events.union(ends(df.sparkSession, len(halves.groups), (0.0, 1.0))), halves)
    top = F.col("hits") / F.col("n_train")
    picked = F.when(F.round(top, 4) < top, F.col("last")).otherwise(F.col("first"))
    out = best.withColumn("p", picked).where("n_test > 0")
    out = out.select("_g", "split", "p.threshold", "p.inverted", top.alias("train_accuracy"), (F.col("p.right") / F.col("n_test")).alias("test_accuracy"), "n_test")
    return named(out, df, by, halves.groups)


def named(out: DataFrame, df: DataFrame, by: list[str], groups: list[tuple]) -> DataFrame:
    """``out`` with the values of ``by`` in place of ``_g``."""
    if not by:
        return out.drop("_g")
    kinds = ", ".join(f"_by{i} {df.schema[c].dataType.simpleString()}" for i, c in enumerate(by))
    codes = out.sparkSession.createDataFrame([(*k, i) for i, k in enumerate(groups)], f"{kinds}, _code int")
    rest = [c for c in out.columns if c != "_g"]
    return out.join(F.broadcast(codes), F.col("_g") == F.col("_code")).select(*[F.col(f"_by{i}").alias(c) for i, c in enumerate(by)], *rest)
