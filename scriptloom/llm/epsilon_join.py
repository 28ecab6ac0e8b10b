"""Embedding near-duplicates by an epsilon grid order join."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.workspace import discard, set_for, shuffle_partitions, write_table
from .bk_tree import Union
from .components import connected_components
from .vectors import is_valid, matrix, sample, width_of

#: Rows of a block of the sequence, and of an interval that is compared without further splitting.
BLOCK_ROWS, LEAF_ROWS = 4096, 256
#: Bytes of vectors of a tile: a task compares two tiles, one of them held.  Pairs of blocks that Python gets at a time.
TILE_BYTES, PAIR_ROWS = 16 << 20, 4
#: Vectors that the principal axes are fitted on at most; they steer pruning only.
SAMPLE_ROWS = 20_000


def leading_axes(x: np.ndarray, k: int, rounds: int = 30) -> np.ndarray:
    """``k`` leading principal axes (columns) of rows of ``x``, by orthogonal iteration."""
    x = x - x.mean(0)
    covariance = np.einsum("ij,ik->jk", x, x)
    k = min(k, len(covariance))
    axes = np.eye(len(covariance))[:, np.argsort(-np.diag(covariance), kind="stable")[:k]]
    for _ in range(rounds):
        axes = np.einsum("ij,jk->ik", covariance, axes)
        for j in range(k):
            for i in range(j):
                axes[:, j] -= axes[:, i] * (axes[:, i] * axes[:, j]).sum()
            n = math.sqrt((axes[:, j] ** 2).sum())
            axes[:, j] = axes[:, j] / n if n > 1e-12 else 0
    return axes


def _gap(lo_a, hi_a, lo_b, hi_b) -> float:
    """Squared distance of two boxes: no more than that of any two points in them."""
    d = np.maximum(0, np.maximum(lo_a - hi_b, lo_b - hi_a))
    return float((d * d).sum())


class _Boxes:
    """Boxes of intervals of a sequence of points, by halving."""

    def __init__(self, points: np.ndarray):
        self.points, self._known = points, {}

    def of(self, i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
        if (i, j) not in self._known:
            part = self.points[i:j]
            self._known[i, j] = part.min(0), part.max(0)
        return self._known[i, j]


def interval_pairs(lo: np.ndarray, hi: np.ndarray, epsilon: float) -> list[tuple[int, int, int]]:
    """(block, first partner, end): the runs of partners, from the block itself on, that aren't provably distant.

    ``lo`` and ``hi`` are corners of the blocks' boxes in grid order; intervals of the
    sequence are joined recursively, and a pair of intervals whose boxes lie more than
    ``epsilon`` apart is skipped whole.
    """
    n, limit = len(lo), epsilon * epsilon * (1 + 1e-9)
    boxes: dict[tuple[int, int], tuple] = {}

    def box(i: int, j: int):
        if (i, j) not in boxes:
            boxes[i, j] = lo[i:j].min(0), hi[i:j].max(0)
        return boxes[i, j]

    partners: list[list[int]] = [[] for _ in range(n)]
    stack = [(0, n, 0, n)] if n else []
    while stack:
        a, b, c, d = stack.pop()
        if b <= a or d <= c or a >= d or _gap(*box(a, b), *box(c, d)) > limit:
            continue
        if b - a == 1 and d - c == 1:
            if a <= c:
                partners[a].append(c)
        elif b - a >= d - c:
            m = (a + b) // 2
            stack += [(a, m, c, d), (m, b, c, d)]
        else:
            m = (c + d) // 2
            stack += [(a, b, c, m), (a, b, m, d)]
    runs = []
    for i, found in enumerate(partners):
        found.sort()
        for k, p in enumerate(found):
            if k and found[k - 1] == p - 1:
                runs[-1] = (i, runs[-1][1], p + 1)
            else:
                runs.append((i, p, p + 1))
    return runs


def class_hash(v: Column) -> Column:
    """The same for equal vectors, whatever the sign of their zeros."""
    return F.xxhash64(v)


class Block:
    """Vectors of a block: as they are, their lengths, the unit vectors in single precision, boxes of intervals."""

    def __init__(self, x: np.ndarray, axes: np.ndarray):
        self.x, self.norms = x, np.sqrt(np.einsum("ij,ij->i", x, x))
        unit = x / self.norms[:, None]
        self.unit, self.boxes = unit.astype(np.float32), _Boxes(unit @ axes)


def join_blocks(left: Block, right: Block, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows (i of ``left``, j of ``right``) whose cosine is at least ``threshold``; i < j, if both are one block.

    Intervals of the two sequences are joined recursively as blocks are.  What a
    product in single precision can't rule out is decided in double precision.
    """
    same = left is right
    limit = (2 - 2 * threshold) * (1 + 1e-9) + 1e-12
    stack = [(0, len(left.x), 0, len(right.x))]
    while stack:
        a, b, c, d = stack.pop()
        if b <= a or d <= c or same and a >= d or _gap(*left.boxes.of(a, b), *right.boxes.of(c, d)) > limit:
            continue
        if b - a <= LEAF_ROWS and d - c <= LEAF_ROWS:
            i, j = np.nonzero(left.unit[a:b] @ right.unit[c:d].T >= threshold - 1e-5)
            i, j = i + a, j + c
            if same:
                i, j = i[i < j], j[i < j]
            for s in range(0, len(i), 1 << 16):
                p, q = i[s : s + (1 << 16)], j[s : s + (1 << 16)]
                sure = np.einsum("ij,ij->i", left.x[p], right.x[q]) / (left.norms[p] * right.norms[q]) >= threshold
                if sure.any():
                    yield p[sure], q[sure]
        elif b - a >= d - c:
            m = (a + b) // 2
            stack += [(a, m, c, d), (m, b, c, d)]
        else:
            m = (c + d) // 2
            stack += [(a, b, c, m), (a, b, m, d)]


class _Found:
    """Link counts and a spanning forest of the links of a task's blocks."""

    def __init__(self) -> None:
        self.starts: dict[int, int] = {}
        self.ids: list = []
        self.n, self.links, self.union, self.edges = np.zeros(0, np.int64), np.zeros(0, np.int64), Union(0), []

    def start(self, block: int, row: pa.StructScalar) -> int:
        """The place of the first row of a block among the task's."""
        if block not in self.starts:
            self.starts[block] = size = len(self.ids)
            self.ids += row["ids"].as_py()
            more = len(self.ids) - size
            self.n = np.concatenate([self.n, np.array(row["n"].as_py(), np.int64)])
            self.links = np.concatenate([self.links, np.zeros(more, np.int64)])
            self.union.parent = np.concatenate([self.union.parent, np.arange(size, size + more)])
        return self.starts[block]

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        np.add.at(self.links, i, self.n[j])
        np.add.at(self.links, j, self.n[i])
        self.edges += self.union.join_all(i, j)


def cosine_components(vectors: DataFrame, row_id: str = "vec_id", embedding: str = "embedding", threshold: float = 0.9, dims: int = 6, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Links by cosine >= ``threshold`` (0 < threshold <= 1) among all rows of ``vectors``.

    Returns ``row_id``, n_links (other rows linked directly), component_id (smallest id
    that links reach, its own included), kept (whether those two ids agree) for each
    row.  Vectors that are null, empty, zero or hold null or non-finite components
    have no links; a shorter vector counts as filled up with zeros.  Rows that repeat
    an id are vectors of their own.

    Equal vectors are one class, so copies make no pairs.  Classes are sorted by cells of
    side epsilon (the distance of unit vectors at the threshold) along the leading
    principal axes and cut into blocks; boxes of blocks (two corners each) come to the
    driver, which joins intervals of the sequence recursively; pairs of blocks that stay
    are joined likewise by tasks.  A task reads two tiles of successive blocks from the
    shared folder, so pairs are not exchanged and disk grows with the vectors, not with
    their pairs.  It returns link counts and a spanning forest of its links, at most two
    rows for each vector of its tiles.
    """
    spark = vectors.sparkSession
    kind = vectors.schema[row_id].dataType.simpleString()
    epsilon = math.sqrt(2 - 2 * threshold) or 1e-6
    single = vectors.schema[embedding].dataType.simpleString() == "array<float>"
    real, stored = ("float", np.float32) if single else ("double", np.float64)
    rows = vectors.select(F.col(row_id).alias("id"), F.col(embedding).cast(f"array<{real}>").alias("v"))
    valid = rows.where(is_valid(F.col("v")))
    # Rows find their class by a hash of the vector, which is smaller; should it stand for two vectors, by these as well.
    every = write_table(valid.groupBy("v").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n")).withColumn("h", class_hash(F.col("v"))), "vector-classes")
    keys = ["h"] if every.groupBy("h").count().where("count > 1").isEmpty() else ["h", "v"]
    classes = every.where("rep IS NOT NULL")
    width = width_of(classes, "v")
    fit = sample(classes, "rep", ["rep", "v"], SAMPLE_ROWS)
    points = np.array([r["v"] + [0.0] * (width - len(r["v"])) for r in fit]).reshape(-1, width)
    axes = leading_axes(points / np.sqrt((points**2).sum(1))[:, None], dims) if len(points) else np.zeros((width, 0))

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = matrix(b.column("v"), width)
            x = (x / np.sqrt((x * x).sum(1))[:, None]) @ axes
            grid = np.floor(x / epsilon).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(list(grid), pa.list_(pa.int32()))], names=[*b.schema.names, "cell"])

    ordered = classes.select("v", "rep", "n").mapInArrow(cells, f"v array<{real}>, rep {kind}, n long, cell array<int>")
    count = classes.count()
    tile_rows = max(block_rows, TILE_BYTES // (width * stored().itemsize))
    parts = max(1, -(-count // tile_rows), min(math.isqrt(4 * shuffle_partitions(spark)) + 1, -(-count // block_rows)))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32

        def block(x: np.ndarray, ids: list, n: np.ndarray) -> pa.RecordBatch:
            p = (x / np.sqrt((x * x).sum(1))[:, None]) @ axes
            values = [pa.array([number], pa.int64()), pa.array([x.astype(stored).tobytes()], pa.binary()), pa.array([ids]), pa.array([n.tolist()], pa.list_(pa.int64())), pa.array([p.min(0).tolist()], pa.list_(pa.float64())), pa.array([p.max(0).tolist()], pa.list_(pa.float64()))]
            return pa.RecordBatch.from_arrays(values, names=["block", "x", "ids", "n", "lo", "hi"])

        xs, ids, ns = np.zeros((0, width)), [], np.zeros(0, np.int64)
        for b in batches:
            xs = np.concatenate([xs, matrix(b.column("v"), width)])
            ids += b.column("rep").to_pylist()
            ns = np.concatenate([ns, b.column("n").to_numpy(zero_copy_only=False)])
            while len(ids) >= block_rows:
                yield block(xs[:block_rows], ids[:block_rows], ns[:block_rows])
                xs, ids, ns, number = xs[block_rows:], ids[block_rows:], ns[block_rows:], number + 1
        if ids:
            yield block(xs, ids, ns)

    sequence = ordered.repartitionByRange(parts, "cell", "rep").sortWithinPartitions("cell", "rep").drop("cell")
    made = write_table(sequence.mapInArrow(blocks, f"block long, x binary, ids array<{kind}>, n array<long>, lo array<double>, hi array<double>"), "vector-blocks")
    meta = sorted((r["block"], r["lo"], r["hi"]) for r in made.select("block", "lo", "hi").collect())
    corners = [np.array([m[i] for m in meta]) for i in (1, 2)]
    partners: list[list[tuple[int, int]]] = [[] for _ in meta]
    for i, a, b in interval_pairs(*corners, epsilon) if meta else []:
        partners[i].append((a, b))
    places = spark.createDataFrame([(m[0], i, partners[i]) for i, m in enumerate(meta)], "block long, at int, runs array<struct<first:int,end:int>>")
    numbered = made.select("block", F.struct("x", "ids", "n").alias("rows")).join(F.broadcast(places), "block")
    left = numbered.select(F.col("at").alias("i"), F.col("runs").alias("_ri"), F.col("rows").alias("left"))
    right = numbered.select(F.col("at").alias("j"), F.col("runs").alias("_rj"), F.col("rows").alias("right"))
    near = lambda runs, at: F.exists(runs, lambda r: (r["first"] <= F.col(at)) & (F.col(at) < r["end"]))
    # Each pair once: those of even distance in one order, others in the other one, so that all pairs of tiles have their share.
    odd = F.abs(F.col("i") - F.col("j")) % 2 == 1
    chosen = (~odd & (F.col("i") <= F.col("j")) & near("_ri", "j")) | (odd & (F.col("i") > F.col("j")) & near("_rj", "i"))
    work = left.hint("shuffle_replicate_nl").join(right, chosen).select("i", "j", "left", "right")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, held, kinds = _Found(), (-1, None), None
        vectors_of = lambda row: Block(np.frombuffer(row["x"].as_buffer(), stored).astype(np.float64).reshape(-1, width), axes)
        for batch in batches:
            kinds = batch.schema.field("left").type.field("ids").type.value_type
            for i, j, left, right in zip(batch.column("i").to_pylist(), batch.column("j").to_pylist(), batch.column("left"), batch.column("right")):
                if held[0] != i:
                    held = i, vectors_of(left)
                x = held[1]
                y = x if i == j else vectors_of(right)
                p, q = found.start(i, left), found.start(j, right)
                for a, b in join_blocks(x, y, threshold):
                    found.add(a + p, b + q)
        if found.links.any():
            some = np.flatnonzero(found.links).tolist()
            a = [found.ids[k] for k in some] + [found.ids[i] for i, _ in found.edges]
            b = [None] * len(some) + [found.ids[j] for _, j in found.edges]
            yield pa.RecordBatch.from_arrays([pa.array(a, kinds), pa.array(b, kinds), pa.array([int(found.links[k]) for k in some] + [0] * len(found.edges), pa.int64())], names=["a", "b", "links"])

    with set_for(spark, {"spark.sql.files.maxPartitionBytes": str(TILE_BYTES * 5 // 4), "spark.sql.execution.arrow.maxRecordsPerBatch": str(PAIR_ROWS)}):
        found = write_table(work.mapInArrow(compare, f"a {kind}, b {kind}, links long"), "vector-links")
    discard(made)
    reached = connected_components(found.select("a", "b"))
    counts = found.groupBy(F.col("a").alias("_a")).agg(F.sum("links").alias("_links"))
    per_class = (
        classes.select(*[F.col(k).alias(f"_{k}") for k in keys], "rep", "n")
        .join(counts, F.col("rep") == F.col("_a"), "left")
        .join(reached, F.col("rep") == F.col("node"), "left")
        .select(*[f"_{k}" for k in keys], (F.col("n") - 1 + F.coalesce("_links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    )
    keyed = rows.withColumn("v", F.when(is_valid(F.col("v")), F.col("v"))).withColumn("h", F.when(F.col("v").isNotNull(), class_hash(F.col("v")))).select("id", *keys)
    # Classes whose ids are all null have no row in ``per_class``; such rows stand alone, as invalid ones do.
    out = keyed.join(per_class, [keyed[k] == per_class[f"_{k}"] for k in keys], "left")
    return out.select(
        F.col("id").alias(row_id),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "id").alias("component_id"),
        F.coalesce(F.coalesce("component_id", "id") == F.col("id"), F.lit(True)).alias("kept"),
    )
