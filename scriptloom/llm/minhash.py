"""MinHash marks: sets that are alike share the least of their members under some of many orders.

A row posts its marks; rows with one mark in common (a shard) meet.  A shard of many
rows is dealt to blocks in the order of their sizes, and pairs of blocks are units of
work, so no task compares more than two blocks, however hot a shard is.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.workspace import discard, shuffle_partitions, write_table
from .bk_tree import Union

_MIX = np.uint64(0x9E3779B97F4A7C15)
#: A post is one long: column of the mark, mark (32 bits), size of the row.
SIZE_BITS, COLUMNS = 25, 16
#: Rows of a block of a shard at most, where rows meet and where their bodies are compared.
BLOCK_ROWS, BODY_ROWS = 4096, 2048
#: Rows whose bodies are read at a time, and pairs of theirs that wait to be compared, in so many rounds.
PART_ROWS, PAIRS, ROUNDS = 1 << 12, 2048, 4


def mixed(x: np.ndarray) -> np.ndarray:
    """Hashes (uint64) of numbers."""
    out = x >> np.uint64(32)
    out ^= x
    out *= _MIX
    out ^= out >> np.uint64(29)
    return out


def marks(members: np.ndarray, starts: np.ndarray, orders: int) -> np.ndarray:
    """The least hash of each set under each of ``orders`` orders, in 32 bits and never 0: one row a set, a column an order.

    ``members`` are hashes of the sets' members, set after set; ``starts`` is where each
    (non-empty) set begins.  Two sets agree in a column with the probability of their
    Jaccard similarity.
    """
    out = np.empty((len(starts), orders), np.uint64)
    factors = mixed(np.arange(1, orders + 1, dtype=np.uint64)) | np.uint64(1)
    for k in range(orders):
        out[:, k] = mixed(np.minimum.reduceat(members * factors[k], starts) + np.uint64(k))
    return np.maximum(out >> np.uint64(32), np.uint64(1))


def posts_of(made: np.ndarray, sizes: np.ndarray, first_column: int = 0) -> np.ndarray:
    """Marks (rows x columns, uint64 of 32 bits) and sizes of rows as posts (int64)."""
    columns = np.arange(first_column, first_column + made.shape[1], dtype=np.uint64)
    size = np.minimum(sizes, (1 << SIZE_BITS) - 1).astype(np.uint64)[:, None]
    return (columns << np.uint64(32 + SIZE_BITS) | made << np.uint64(SIZE_BITS) | size).view(np.int64)


def sketches(made: np.ndarray) -> np.ndarray:
    """Nine bits of each of the first seven of eight marks, as one long: which marks two rows share, but for chance (once in 512)."""
    out = np.zeros(len(made), np.uint64)
    for k in range(made.shape[1] - 1):
        out |= (made[:, k] & np.uint64(511)) << np.uint64(9 * k)
    return out.view(np.int64)


def close_rows(column: np.ndarray, bits: np.ndarray, a: np.ndarray, b: np.ndarray, reach: np.ndarray) -> np.ndarray:
    """Whether rows that meet in a column share none of the marks of the columns before it, and differ in no more
    ``bits`` than ``reach`` (a row for each eight columns) allows for the marks that they share; by their sketches (int64)."""
    differ, first, shared = a ^ b, np.ones(len(a), bool), np.ones(len(a), np.int64)
    own = column % 8
    for k in range(7):
        same = (column < COLUMNS) & (differ >> (9 * k) & 511 == 0)
        first &= ~same | (k >= own)
        shared += same & (k > own)
    return first & (bits <= reach[column // 8, shared])


def blocks_of_shards(batches: Iterator[pa.RecordBatch], limit: int, ratio: float, rows: int = 1 << 17) -> Iterator[tuple[str, dict[str, np.ndarray]]]:
    """Rows sorted by shard and size as ``whole`` parts (of whole shards of at most ``limit`` rows), ``block`` parts (one
    block of ``limit`` rows of a larger shard, numbered in column ``block``), and after the last block of a shard
    ``pairs`` (shard, i, j): the pairs of its blocks, each with itself included, but for those all of whose sizes
    are further apart than ``ratio`` to 1.  Held are ``rows`` rows and a batch."""
    held: dict[str, np.ndarray] | None = None
    opened: list[tuple[int, int]] = []
    hot = 0

    def close() -> Iterator[tuple[str, dict[str, np.ndarray]]]:
        for i in range(len(opened)):
            end = next((j for j in range(i, len(opened)) if opened[j][0] * ratio > opened[i][1] + 1e-6), len(opened))
            j = np.arange(i, end, dtype=np.int32)
            yield "pairs", {"shard": np.full(len(j), hot), "i": np.full(len(j), i, np.int32), "j": j}
        opened.clear()

    def advance(data: dict[str, np.ndarray], final: bool) -> Iterator[tuple[str, dict[str, np.ndarray]]]:
        nonlocal held, hot
        shard = data["shard"]
        n = len(shard)
        if opened and (not n or shard[0] != hot):
            yield from close()
        held = {c: v[n:] for c, v in data.items()}
        if not n:
            return
        bounds = np.r_[0, np.flatnonzero(shard[1:] != shard[:-1]) + 1, n]
        sizes = np.diff(bounds)
        done = len(sizes) if final else len(sizes) - 1
        big = sizes > limit
        big[0] |= bool(opened)
        small = ~big
        small[done:] = False
        if small.any():
            chosen = np.repeat(small, sizes)
            yield "whole", {c: v[chosen] for c, v in data.items()}
        start = int(bounds[done])
        for r in np.flatnonzero(big).tolist():
            s, e = int(bounds[r]), int(bounds[r + 1])
            hot = int(shard[s])
            while e - s >= limit or r < done and e > s:
                m = min(limit, e - s)
                yield "block", {c: v[s : s + m] for c, v in data.items()} | {"block": np.full(m, len(opened), np.int32)}
                opened.append((int(data["size"][s]), int(data["size"][s + m - 1])))
                s += m
            if r < done:
                yield from close()
            else:
                start = s
        held = {c: v[start:] for c, v in data.items()}

    waiting: list[dict[str, np.ndarray]] = []
    count = 0
    for batch in batches:
        waiting.append({c: batch.column(c).to_numpy(zero_copy_only=False) for c in batch.schema.names})
        count += batch.num_rows
        if count >= rows:
            parts = [held, *waiting] if held else waiting
            yield from advance({c: np.concatenate([p[c] for p in parts]) for c in waiting[0]}, False)
            waiting, count = [], 0
    parts = [held, *waiting] if held else waiting
    if parts:
        yield from advance({c: np.concatenate([p[c] for p in parts]) for c in parts[0]}, True)
        yield from close()


def in_company(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """shard, size, id, fp, sketch of sorted posts (post, id, fp, sketch) without those that are alone in their shard: most are."""
    last, shared = None, False
    for batch in batches:
        if not batch.num_rows:
            continue
        if last is not None:
            batch = pa.Table.from_batches([last, batch]).combine_chunks().to_batches()[0]
        shard = batch.column("post").to_numpy() >> SIZE_BITS
        same = shard[1:] == shard[:-1]
        # Whether the last row is alone shows in the next batch.
        keep = np.r_[shared or same[:1].any(), same[1:] | same[:-1]] if len(same) else np.zeros(0, bool)
        last, shared = batch.slice(len(same)), bool(same[-1]) if len(same) else shared
        if keep.any():
            yield _sized(batch.slice(0, len(same)).filter(pa.array(keep)))
    if shared:
        yield _sized(last)


def _sized(batch: pa.RecordBatch) -> pa.RecordBatch:
    post = batch.column("post").to_numpy()
    size = pa.array((post & ((1 << SIZE_BITS) - 1)).astype(np.int32))
    return pa.RecordBatch.from_arrays([pa.array(post >> SIZE_BITS), size, *[batch.column(c) for c in ("id", "fp", "sketch")]], names=["shard", "size", "id", "fp", "sketch"])


def near_rows(part: dict[str, np.ndarray], units: tuple[str, ...], reach: np.ndarray, ratio: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows (a < b) of one unit that are close (``close_rows``) and whose sizes are at least as ``ratio`` to 1.

    Rows are sorted by unit and size: a row's partners end where sizes are too large.
    Where two blocks meet, rows of one block are left to the unit in which it meets itself.
    """
    size, fp, sketch, column = part["size"], part["fp"].astype(np.int64).view(np.uint64), part["sketch"], part["shard"] >> 32
    n = len(size)
    change = np.zeros(n - 1, bool)
    for c in units:
        change |= part[c][1:] != part[c][:-1]
    ends = np.flatnonzero(np.r_[change, True]) + 1
    last = np.repeat(ends, np.diff(np.r_[0, ends]))
    most, widest = np.floor(size / ratio + 1e-9), reach.max(1)[column // 8]
    at, step = np.arange(n), 1
    while len(at):
        at = at[at + step < last[at]]
        at = at[size[at + step] <= most[at]]
        a = at
        if "j" in part:
            a = a[(part["i"][a] == part["j"][a]) | (part["block"][a] != part["block"][a + step])]
        bits = np.bitwise_count(fp[a] ^ fp[a + step])
        near = bits <= widest[a]
        a, bits = a[near], bits[near]
        if len(a):
            a = a[close_rows(column[a], bits, sketch[a], sketch[a + step], reach)]
            yield a, a + step
        step += 1


def _met_batch(part: dict[str, np.ndarray], chosen: np.ndarray) -> pa.RecordBatch:
    n = int(chosen.sum())
    none = pa.nulls(n, pa.int32())
    arrays = [*[pa.array(part[c][chosen]) for c in ("id", "shard", "sketch")], pa.array(part["size"][chosen], pa.int32()), pa.array(part["fp"][chosen]), none, none, none]
    return pa.RecordBatch.from_arrays(arrays, names=_MET_NAMES)


_MET_NAMES = ["id", "shard", "sketch", "size", "fp", "block", "i", "j"]
_MET_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]
_MET = "id long, shard long, sketch long, size int, fp long, block int, i int, j int"


def _by_pairs_of_blocks(made: DataFrame) -> DataFrame:
    """The ``block`` rows of a table that ``blocks_of_shards`` gave, for each pair of blocks that they are in."""
    pairs = made.where("i IS NOT NULL").select(F.col("shard").alias("_shard"), "i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("_block"))
    rows = made.where("block IS NOT NULL").drop("i", "j")
    # Keys are (shard, block): no key has more rows than a block, or than there are blocks.
    return rows.join(pairs, (rows["shard"] == pairs["_shard"]) & (rows["block"] == pairs["_block"])).drop("_shard", "_block")


def _grouped(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[dict[str, np.ndarray]]:
    """Sorted batches joined to parts of about ``rows`` rows that end where a unit (shard, i, j) ends."""
    held: pa.Table | None = None
    for batch in batches:
        held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
        if held.num_rows >= rows:
            keys = [held.column(c).to_numpy() for c in ("shard", "i", "j")]
            other = np.flatnonzero(np.logical_or.reduce([k != k[-1] for k in keys]))
            cut = int(other[-1]) + 1 if len(other) else 0
            if cut:
                yield _arrays(held.slice(0, cut))
                held = held.slice(cut)
    if held is not None and held.num_rows:
        yield _arrays(held)


def _arrays(table: pa.Table) -> dict[str, np.ndarray]:
    out = {}
    for c in table.schema.names:
        column = table.column(c).combine_chunks()
        column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
        out[c] = column.to_numpy(zero_copy_only=False)
    return out


def meetings(posted: DataFrame, reach: np.ndarray, ratio: float, block_rows: int = BLOCK_ROWS, near: Callable = near_rows) -> DataFrame:
    """id, shard, sketch, size, fp: where a row of ``posted`` (id long, fp long, sketch long, post long) shares a mark with a
    row of another id that is close (as ``near`` finds), with sizes at least as ``ratio`` to 1.  Rows may repeat."""
    n = shuffle_partitions(posted.sparkSession)
    shard = F.shiftright("post", SIZE_BITS)
    dealt = posted.select("post", "id", "fp", "sketch").repartition(n, shard).sortWithinPartitions("post")

    def compare(part: dict[str, np.ndarray], units: tuple[str, ...]) -> np.ndarray:
        met = np.zeros(len(part["id"]), bool)
        for a, b in near(part, units, reach, ratio):
            other = part["id"][a] != part["id"][b]
            met[a[other]] = met[b[other]] = True
        return met

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for kind, part in blocks_of_shards(in_company(batches), block_rows, ratio):
            if kind == "whole":
                yield _met_batch(part, compare(part, ("shard",)))
            else:
                m = len(part["shard"])
                columns = {c: pa.array(part[c]) if c in part else pa.nulls(m, t) for c, t in zip(_MET_NAMES, _MET_TYPES)}
                yield pa.RecordBatch.from_arrays([columns[c].cast(t) for c, t in zip(_MET_NAMES, _MET_TYPES)], names=_MET_NAMES)

    def meet_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _grouped(batches, 1 << 15):
            yield _met_batch(part, compare(part, ("shard", "i", "j")))

    made = write_table(dealt.mapInArrow(meet, _MET), "met")
    met = made.where("id IS NOT NULL AND block IS NULL").select("id", "shard", "sketch", "size", "fp")
    met.written_path = made.written_path
    if made.where("i IS NOT NULL").isEmpty():
        return met
    units = _by_pairs_of_blocks(made.select("shard", "size", "id", "fp", "sketch", "block", "i", "j"))
    units = units.repartition(n, "shard", "i", "j").sortWithinPartitions("shard", "i", "j", "size").select("shard", "i", "j", "block", "size", "id", "fp", "sketch")
    both = met.union(units.mapInArrow(meet_blocks, _MET).select("id", "shard", "sketch", "size", "fp"))
    both.written_path = made.written_path
    return both


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by shard, size and id without those that repeat the one before."""
    last = None
    for batch in batches:
        keys = [batch.column(c).to_numpy() for c in ("shard", "id")]
        new = np.ones(batch.num_rows, bool)
        new[1:] = (keys[0][1:] != keys[0][:-1]) | (keys[1][1:] != keys[1][:-1])
        if batch.num_rows:
            new[0] = (keys[0][0], keys[1][0]) != last
            last = keys[0][-1], keys[1][-1]
        yield batch.filter(pa.array(new))


def units_of_work(met: DataFrame, ratio: float, block_rows: int = BODY_ROWS) -> DataFrame:
    """shard, i, j, block, size, id, sketch, fp: the rows of ``met`` (id, shard, sketch, size, fp) for each unit that they are compared in."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for kind, part in blocks_of_shards(_once(batches), block_rows, ratio):
            m = len(part["shard"])
            if kind == "whole":
                part = part | {"block": np.zeros(m, np.int32), "i": np.zeros(m, np.int32), "j": np.zeros(m, np.int32)}
            columns = [pa.array(part[c]).cast(t) if c in part else pa.nulls(m, t) for c, t in zip(_MET_NAMES, _MET_TYPES)]
            yield pa.RecordBatch.from_arrays(columns, names=_MET_NAMES)

    n = shuffle_partitions(met.sparkSession)
    dealt = met.repartition(n, "shard").sortWithinPartitions("shard", "size", "id").mapInArrow(deal, _MET)
    made = write_table(dealt, "dealt")
    whole = made.where("id IS NOT NULL AND i IS NOT NULL")
    split = _by_pairs_of_blocks(made.where("id IS NULL OR i IS NULL"))
    columns = ["shard", "i", "j", "block", "size", "id", "sketch", "fp"]
    return whole.select(*columns).union(split.select(*columns))


def met_units(posted: DataFrame, reach: np.ndarray, ratio: float, near: Callable = near_rows) -> DataFrame:
    """``units_of_work`` of ``meetings``, whose own table goes."""
    made = meetings(posted, reach, ratio, near=near)
    units = units_of_work(made, ratio)
    discard(made)
    return units


def decided(union: Union, edges: list[tuple[int, int]], a: np.ndarray, b: np.ndarray, fp: np.ndarray, alike: Callable) -> None:
    """Join in ``union`` the rows of all pairs (a, b) that are ``alike``, and add those that this joined to ``edges``.

    Rows that are joined already need no proof that they are.  So a round compares a forest of the pairs, those of the
    fewest bits between them first: if all of it is alike, none was compared in vain.  The last round compares the rest.
    """
    order = np.argsort(np.bitwise_count(fp[a].astype(np.int64) ^ fp[b].astype(np.int64)), kind="stable")
    a, b = a[order], b[order]
    for turn in range(ROUNDS):
        apart = union.roots(a) != union.roots(b)
        a, b = a[apart], b[apart]
        if not len(a):
            return
        now = np.ones(len(a), bool) if turn == ROUNDS - 1 else forest(union.roots(a), union.roots(b))
        u, v = a[now], b[now]
        edges.extend(union.join_all(u[sure := alike(u, v)], v[sure]))
        a, b = a[~now], b[~now]


def forest(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which of the pairs (a, b), in their order, join what those before them don't."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            parent[x] = x = parent.get(up, up)
        return x

    out = np.zeros(len(a), bool)
    for k, (x, y) in enumerate(zip(a.tolist(), b.tolist())):
        x, y = root(x), root(y)
        if x != y:
            parent[x] = y
            out[k] = True
    return out


def verified_links(units: DataFrame, rows: DataFrame, prepare: Callable, reach: np.ndarray, ratio: float, near: Callable = near_rows, part_rows: int = PART_ROWS, pairs: int = PAIRS) -> DataFrame:
    """Edges (a, b) between keys of ``rows`` (id long, key binary, body) that meet in
    a unit (``units_of_work``) and are alike; a forest of them per unit.

    A pair that shares several marks is compared in the column of the first only, as it was found.
    ``prepare(bodies, sizes)`` makes a part's two tests of pairs (arrays of places): one that may
    rule out what can't be alike, and one that decides.
    """
    n = shuffle_partitions(units.sparkSession)
    work = units.join(rows.withColumnRenamed("id", "_id"), F.col("id") == F.col("_id")).select("shard", "i", "j", "block", "size", "sketch", "key", "fp", "body")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _grouped(batches, part_rows):
            key = part["key"]
            may, alike = prepare(part["body"], part["size"])
            union = Union(len(key))
            edges: list[tuple[int, int]] = []
            waiting: list[tuple[np.ndarray, np.ndarray]] = []

            def decide() -> None:
                a, b = (np.concatenate(x) for x in zip(*waiting))  # noqa: B023
                waiting.clear()  # noqa: B023
                decided(union, edges, a, b, part["fp"], alike)  # noqa: B023

            for a, b in near(part, ("shard", "i", "j"), reach, ratio):
                apart = union.roots(a) != union.roots(b)
                a, b = a[apart], b[apart]
                likely = may(a, b) if len(a) else apart
                if likely.any():
                    waiting.append((a[likely], b[likely]))
                    if sum(len(x) for x, _ in waiting) >= pairs:
                        decide()
            if waiting:
                decide()
            if edges:
                yield pa.RecordBatch.from_arrays([pa.array([key[u] for u, _ in edges], pa.binary()), pa.array([key[v] for _, v in edges], pa.binary())], names=["a", "b"])

    return work.repartition(n, "shard", "i", "j").sortWithinPartitions("shard", "i", "j", "size").mapInArrow(verify, "a binary, b binary")


def id_of(key: str | Column) -> Column:
    """The long that stands for a key where rows meet; links are between keys."""
    return F.xxhash64(key)
