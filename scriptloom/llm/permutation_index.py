"""Approximate nearest neighbours by a permutation index with pivot inverted files."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.workspace import shuffle_partitions, write_table
from .vectors import is_valid, matrix, sample, width_of


class PermutationBlock:
    """Inverted files of one block of vectors: for each pivot, at what rank each vector has it, ``prefix`` if it is not among its nearest.

    With half of the pivots in a prefix half of all entries are there, so files are dense
    bytes: they are read in order, without places of vectors.
    """

    def __init__(self, near: np.ndarray, pivots: int):
        self.rows, self.prefix = near.shape
        self.files = np.full((pivots, self.rows), self.prefix, np.uint8)
        self.files[near.T, np.arange(self.rows)[None, :]] = np.arange(self.prefix, dtype=np.uint8)[:, None]
        self._larger, self._sum = np.empty(self.rows, np.uint8), np.empty(self.rows, np.uint16)

    def distance(self, query: np.ndarray) -> np.ndarray:
        """Half the footrule distance of two prefixes, less what is the same for all vectors.

        With absent pivots at rank ``prefix`` the distance is a constant less
        2 x (prefix - larger rank) for each pivot in both: only the files of the query's
        own pivots are read.
        """
        total = self._sum
        total[:] = 0
        for rank, pivot in enumerate(query.tolist()):
            np.maximum(self.files[pivot], np.uint8(rank), out=self._larger)
            np.add(total, self._larger, out=total)
        return total


def nearest_pivots(x: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """Each row's ``prefix`` pivots of largest inner product, nearest first, ties to the first pivot."""
    near = np.argsort(-(x @ pivots.T), axis=1, kind="stable")
    return np.ascontiguousarray(near[:, :prefix].astype(np.uint16))


def choose_pivots(unit: np.ndarray, count: int, alike: float = 0.9) -> np.ndarray:
    """Rows of ``unit`` (unit vectors, in random order) that serve as pivots: of rows whose cosine is over ``alike``
    the first only, so that a crowd of near copies has one pivot; the others fill up what is missing."""
    chosen = np.zeros(len(unit), bool)
    for i in range(len(unit)):
        if chosen.sum() == count:
            break
        chosen[i] = not (unit[chosen] @ unit[i] > alike).any()
    rest = np.flatnonzero(~chosen)[: max(0, count - int(chosen.sum()))]
    return np.sort(np.r_[np.flatnonzero(chosen), rest])


def candidates(distance: np.ndarray, weight: np.ndarray, least: int, share: float) -> np.ndarray:
    """Entries no farther than the closest ``share`` of all ``weight``, and than the ``least`` closest."""
    counts, weights = np.bincount(distance), np.bincount(distance, weight)
    reach = max(np.searchsorted(np.cumsum(weights), share * weight.sum()), np.searchsorted(np.cumsum(counts), min(least, len(distance))))
    return np.flatnonzero(distance <= reach)


def nearest_neighbours(
    vectors: DataFrame, queries: Column, k: int = 20, row_id: str = "vec_id", embedding: str = "embedding",
    pivots: int = 256, prefix: int = 128, share: float = 0.1, least: int = 200, block_rows: int = 8192, query_rows: int = 1024,
) -> DataFrame:
    """The ``k`` rows of largest inner product with each row of ``vectors`` for which ``queries`` holds, itself left out.

    Returns query_id, rank (from 1), vec_id, score (the inner product in double
    precision), ties to the smaller id.  Vectors that are null, empty, zero or hold
    null or non-finite components, and rows with a null id, take no part; a shorter
    vector counts as filled up with zeros.  Rows that repeat an id are taken once each.

    Equal vectors are one entry of the index, which holds their ``k`` + 1 smallest ids: as
    ties go to smaller ids, no query can have another of them among its nearest, and
    copies of one vector can't crowd out others.
    Pivots are ``pivots`` vectors of a bounded sample, unlike each other.  A row is represented by
    the order of its ``prefix`` nearest pivots.  The table is cut into blocks, each with
    its inverted files; every query visits every block, ranks its rows by footrule
    distance, and scores the closest ``share`` of its entries (``least`` at least, ties at
    the edge included) exactly; a crowd around one pivot counts as four mean cells at
    most, so that it adds to the others and does not displace them.  Longer vectors have larger products: for the index (not
    for scores) vectors are brought to one length by one more component.
    """
    spark = vectors.sparkSession
    kind = vectors.schema[row_id].dataType.simpleString()
    rows = vectors.select(F.col(row_id).alias("id"), F.col(embedding).cast("array<double>").alias("v"), queries.alias("asks"))
    valid = write_table(rows.where(is_valid(F.col("v")) & F.col("id").isNotNull()), "vectors")
    width = width_of(valid, "v")
    longest = valid.agg(F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)))).first()[0] or 1.0
    fit = sample(valid, "id", ["id", "v"], 20 * pivots)
    drawn = np.unique(np.array([r["v"] + [0.0] * (width - len(r["v"])) for r in fit]).reshape(-1, width), axis=0)
    drawn = drawn[np.random.default_rng(5).permutation(len(drawn))]
    if len(drawn):
        drawn = drawn[choose_pivots(drawn / np.sqrt((drawn**2).sum(1))[:, None], pivots)]
    prefix = min(prefix, len(drawn))
    if prefix > 250:
        raise ValueError("prefix must be at most 250")

    def lifted(x: np.ndarray) -> np.ndarray:
        x = x / longest
        return np.hstack([x, np.sqrt(np.maximum(0, 1 - (x * x).sum(1)))[:, None]])

    pivot = lifted(drawn) if len(drawn) else np.zeros((0, width + 1))

    def pack(size: int, as_query: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            number = TaskContext.get().partitionId() << 32
            xs, ids = np.zeros((0, width)), []

            def block(x: np.ndarray, own: list) -> pa.RecordBatch:
                at = np.hstack([x / np.sqrt((x * x).sum(1))[:, None], np.zeros((len(x), 1))]) if as_query else lifted(x)
                near = nearest_pivots(at, pivot, prefix)
                return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([x.tobytes()], pa.binary()), pa.array([own]), pa.array([near.tobytes()], pa.binary())], names=["block", "x", "ids", "near"])

            for b in batches:
                xs, ids = np.concatenate([xs, matrix(b.column("v"), width)]), ids + b.column("ids").to_pylist()
                while len(ids) >= size:
                    yield block(xs[:size], ids[:size])
                    xs, ids, number = xs[size:], ids[size:], number + 1
            if ids:
                yield block(xs, ids)

        return run

    def blocks(df: DataFrame, size: int, as_query: bool, name: str) -> DataFrame:
        """Entries (first, ids, v) in the order of their first ids, ``size`` to a row."""
        parts = max(1, min(4 * shuffle_partitions(spark), -(-df.count() // size)))
        dealt = df.repartitionByRange(parts, "first").sortWithinPartitions("first").select("ids", "v")
        return write_table(dealt.mapInArrow(pack(size, as_query), f"block long, x binary, ids array<array<{kind}>>, near binary"), name)

    place_of_copy = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    copies = valid.withColumn("copy", place_of_copy).where(F.col("copy") <= k + 1)
    entries = write_table(copies.groupBy("v").agg(F.min("id").alias("first"), F.sort_array(F.collect_list("id")).alias("ids")), "entries")
    index = blocks(entries, block_rows, False, "index")
    asked = blocks(valid.where("asks").select(F.col("id").alias("first"), F.array("id").alias("ids"), "v"), query_rows, True, "queries")
    names = spark.createDataFrame([([r["block"] for r in index.select("block").collect()],)], "all array<long>").first()["all"]
    visits = asked.select(F.col("block").alias("q_block"), F.col("x").alias("q"), F.col("ids").alias("q_ids"), F.col("near").alias("q_near"), F.explode(F.array(*[F.lit(n) for n in names]) if names else F.array().cast("array<long>")).alias("block"))
    work = visits.hint("merge").join(index, "block").repartition(max(1, 4 * len(names)), "q_block", "block")

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                value = lambda c: batch.column(c)[r]  # noqa: E731, B023
                array = lambda c, t, w: np.frombuffer(value(c).as_buffer(), t).reshape(-1, w)  # noqa: E731, B023
                x, q = array("x", np.float64, width), array("q", np.float64, width)
                ids, q_ids = value("ids").as_py(), [i[0] for i in value("q_ids").as_py()]
                files = PermutationBlock(array("near", np.uint16, prefix), len(pivot))
                # A crowd that shares its nearest pivot counts as four cells of mean size at most: it can't take all places.
                cell = array("near", np.uint16, prefix)[:, 0]
                size = np.bincount(cell, minlength=len(pivot))
                weight = np.minimum(1.0, 4 * len(ids) / len(pivot) / size[cell])
                out_q, out_i, out_s = [], [], []
                for one, own, near in zip(q, q_ids, array("q_near", np.uint16, prefix)):
                    chosen = candidates(files.distance(near), weight, max(least, k + 1), share)
                    score = np.einsum("ij,j->i", x[chosen], one)
                    # An entry has one id at least, one may be the query's own; entries are in the order of their first ids.
                    best = np.lexsort((chosen, -score))[: k + 1]
                    found = sorted((-s, i) for s, c in zip(score[best].tolist(), chosen[best].tolist()) for i in ids[c] if i != own)[:k]
                    out_q += [own] * len(found)
                    out_i += [i for _, i in found]
                    out_s += [-s for s, _ in found]
                kinds = batch.schema.field("ids").type.value_type.value_type
                yield pa.RecordBatch.from_arrays([pa.array(out_q, kinds), pa.array(out_i, kinds), pa.array(out_s, pa.float64())], names=["query_id", "vec_id", "score"])

    found = work.mapInArrow(visit, f"query_id {kind}, vec_id {kind}, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
