"""SimHash near-duplicates: fingerprints, pigeonhole shards, BK-trees, components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.workspace import shuffle_partitions, write_table
from .bk_tree import BKForest, Union
from .components import connected_components

#: Rows of a shard tree at most; larger shards are split in so many trees as they need.
TREE_ROWS = 4096


def fingerprint(text: str | None, width: int = 3, seed: int = 42) -> int:
    """64-bit SimHash of the ``width``-word shingles of a text, repeats included; 0 if it has no words.

    A-Z are lower-cased, words are runs without ASCII white space, a shingle is its
    words joined by a space and hashed by XXH64.  Fewer words make one shingle.  A
    bit is 1 if more than half the hashes have it.
    """
    import xxhash

    words = text.encode().lower().split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        return xxhash.xxh64_intdigest(joined, seed)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.r_[0, ends[:-1] + 1]
    digest = xxhash.xxh64_intdigest
    n = len(words) - width + 1
    spans = zip(starts[:n].tolist(), ends[width - 1 :].tolist())
    return majority(np.array([digest(joined[s:e], seed) for s, e in spans], np.uint64))


def majority(hashes: np.ndarray) -> int:
    """The bits that more than half of ``hashes`` (uint64, repeats included) have."""
    votes, n = np.zeros(64, np.int64), len(hashes)
    for i in range(0, n, 1 << 16):
        bits = np.unpackbits(hashes[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes += bits.sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * votes > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """doc_id and ``fp`` (the fingerprint's 64 bits as a long) for each row of ``docs`` (doc_id, text)."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(t, width) for t in batch.column("text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(compute, f"doc_id {kind}, fp long")


def near_links(fps: DataFrame, radius: int = 3, tree_rows: int = TREE_ROWS) -> DataFrame:
    """Links (a, b) between distinct ``fp`` (long) that join all that are within ``radius`` bits of each other.

    Fingerprints within the radius agree in one of radius + 1 blocks of bits, so each
    (block, value) is a shard; BK-trees of a shard are sent to those who query them:
    a shard of up to ``tree_rows`` is one tree, a larger one is dealt by hash to
    several, and its rows query each tree (a pair of trees is a unit of work, so a
    hot shard spreads over tasks).  Only links that join two sets of a unit are
    returned: fewer than its rows, and enough to reach all that any link reaches.
    """
    if not 1 <= radius <= 15:
        raise ValueError("radius must be from 1 to 15")
    blocks = radius + 1
    width = 64 // blocks
    keys = []
    for i in range(blocks):
        bits = width if i < blocks - 1 else 64 - i * width
        value = F.shiftrightunsigned("fp", i * width).bitwiseAND(F.lit((1 << bits) - 1))
        keys.append(F.lit(i << 40).cast("long") + value)
    posts = fps.select("fp", F.explode(F.array(*keys)).alias("shard"))
    # Shards with one row link nothing; those over ``tree_rows`` need several trees.
    sizes = posts.groupBy(F.col("shard").alias("_shard")).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    trees = F.ceil(F.col("_n") / tree_rows).cast("int")
    mine = F.pmod(F.xxhash64("fp", F.lit(7)), F.col("trees")).cast("int")
    dealt = posts.join(sizes, posts["shard"] == sizes["_shard"]).select("fp", "shard", trees.alias("trees")).withColumn("mine", mine)
    other = F.explode(F.sequence(F.lit(0), F.col("trees") - 1)).alias("other")
    units = dealt.select("fp", "shard", "mine", other).select(
        "fp", "shard", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), (F.col("mine") <= F.col("other")).alias("in_tree"), (F.col("mine") >= F.col("other")).alias("asks")
    )

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in whole_units(batches, 1 << 18):
            yield from _link_units(part, radius)

    n = shuffle_partitions(fps.sparkSession)
    return units.repartition(n, "shard", "i", "j").sortWithinPartitions("shard", "i", "j", "fp").mapInArrow(link, "a long, b long")


def whole_units(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[dict[str, np.ndarray]]:
    """Sorted batches joined to parts of about ``rows`` rows that end where a unit (shard, i, j) ends."""
    held: list[dict[str, np.ndarray]] = []
    count = 0
    for batch in batches:
        part = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in batch.schema.names}
        held.append(part)
        count += batch.num_rows
        if count < rows:
            continue
        whole = {c: np.concatenate([p[c] for p in held]) for c in part}
        last = np.flatnonzero((whole["shard"] != whole["shard"][-1]) | (whole["i"] != whole["i"][-1]) | (whole["j"] != whole["j"][-1]))
        cut = int(last[-1]) + 1 if len(last) else 0
        if cut:
            yield {c: v[:cut] for c, v in whole.items()}
        held, count = [{c: v[cut:] for c, v in whole.items()}], len(whole["fp"]) - cut
    if count:
        yield {c: np.concatenate([p[c] for p in held]) for c in held[0]}


def near_pairs(fp: np.ndarray, unit: np.ndarray, shard: np.ndarray, in_tree: np.ndarray, asks: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows (asking, in tree) of one unit within ``radius``; a pair may come several times.

    The rows of a shard agree in one block of bits, so in one of radius + 1 parts of the
    other bits too: each part deals a unit's rows to smaller trees, and rows that are
    alone there are left out.
    """
    blocks = radius + 1
    width = 64 // blocks
    if 64 % blocks:
        parts = [np.zeros(len(fp), np.uint64)]
    else:
        turn = ((shard >> 40) + 1).astype(np.uint64) * np.uint64(width) % np.uint64(64)
        rest = fp >> turn | fp << (np.uint64(64) - turn) % np.uint64(64)  # the shard's own block is on top
        bits = (64 - width) // blocks
        ends = [*range(0, bits * blocks, bits), 64 - width]
        parts = [rest >> np.uint64(s) & np.uint64((1 << (e - s)) - 1) for s, e in zip(ends, ends[1:])]
    for part in parts:
        cell = unit.astype(np.uint64) << np.uint64(32) | part if int(part.max(initial=0)) < 1 << 32 else None
        order = np.lexsort((part, unit)) if cell is None else np.argsort(cell)
        first = np.r_[True, (unit[order][1:] != unit[order][:-1]) | (part[order][1:] != part[order][:-1])]
        sizes = np.diff(np.r_[np.flatnonzero(first), len(order)])
        group = np.empty(len(order), np.int64)
        group[order] = np.cumsum(first) - 1
        busy = sizes[group] > 1
        inside, own = np.flatnonzero(in_tree & busy), np.flatnonzero(asks & busy)
        if len(inside) and len(own):
            for q, node in BKForest(fp[inside], group[inside]).search(fp[own], group[own], radius):
                yield own[q], inside[node]


def _link_units(part: dict[str, np.ndarray], radius: int) -> Iterator[pa.RecordBatch]:
    fp = part["fp"].astype(np.int64)
    union = Union(len(fp))
    found: list[tuple[int, int]] = []
    for a, b in near_pairs(fp.view(np.uint64), units_of(part), part["shard"], part["in_tree"], part["asks"], radius):
        other = a != b
        found += union.join_all(a[other], b[other])
    if found:
        pairs = np.array(found)
        yield pa.RecordBatch.from_arrays([pa.array(fp[pairs[:, 0]]), pa.array(fp[pairs[:, 1]])], names=["a", "b"])


def units_of(part: dict[str, np.ndarray]) -> np.ndarray:
    """The number of the unit that each of the sorted rows belongs to."""
    return np.cumsum(np.r_[False, (part["shard"][1:] != part["shard"][:-1]) | (part["i"][1:] != part["i"][:-1]) | (part["j"][1:] != part["j"][:-1])])


def simhash_components(docs: DataFrame, width: int = 3, radius: int = 3) -> DataFrame:
    """doc_id, fp, component_id of each row of ``docs`` (doc_id, text).

    Documents are linked if their fingerprints differ in at most ``radius`` bits;
    component_id is the smallest doc_id that links reach, the document's own included.
    A null or blank text has fingerprint 0 and is linked like any other.  Rows that
    repeat a doc_id are kept as they are.  Equal fingerprints are one class, so groups
    of copies of any size make no pairs.
    """
    rows = write_table(fingerprints(docs, width), "fingerprints")
    classes = write_table(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "classes")
    links = near_links(classes.select("fp"), radius)
    found = connected_components(links)
    # A component is named by its smallest fingerprint so far; here by its smallest document.
    reached = classes.join(found, classes["fp"] == found["node"], "left").select("fp", "first", F.coalesce("component", "fp").alias("component"))
    reached = write_table(reached, "reached")
    named = reached.groupBy(F.col("component").alias("_c")).agg(F.min("first").alias("component_id"))
    of_class = reached.join(named, reached["component"] == named["_c"]).select(F.col("fp").alias("_fp"), "component_id")
    return rows.join(of_class, rows["fp"] == of_class["_fp"]).select("doc_id", "fp", "component_id")


def keep_one_of_each(docs: DataFrame, width: int = 3, radius: int = 3) -> DataFrame:
    """``docs`` (doc_id, text and any other columns): of each component the document with the smallest doc_id.

    Of rows that repeat that doc_id one stays.  Rows with a null doc_id are kept as
    they are: nothing tells which of them to keep.
    """
    found = simhash_components(docs, width, radius)
    return one_of_each(docs, found.where(F.col("doc_id") == F.col("component_id")).select("doc_id").distinct())


def one_of_each(docs: DataFrame, keep: DataFrame) -> DataFrame:
    """One row of ``docs`` for each doc_id of ``keep``, and those with a null doc_id."""
    packed = docs.select(F.struct("*").alias("row"), "doc_id", F.xxhash64("text").alias("key"))
    # The window needs no other exchange than the join.
    stay = packed.join(keep, "doc_id", "left_semi").withColumn("k", F.row_number().over(Window.partitionBy("doc_id").orderBy("key")))
    kept = stay.where("k = 1").select("row").union(packed.where("doc_id IS NULL").select("row"))
    return kept.select(*[F.col("row")[c].alias(c) for c in docs.columns])
