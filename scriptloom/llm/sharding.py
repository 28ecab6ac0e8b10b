"""K-d tree sharding: recursive splits at distributed weighted medians."""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ranking import number_within
from ..functions.workspace import write_table

_BINS = 1024


@dataclass
class _Split:
    """The search for one node's cut: where it stands on the way through (dimension, text hash, row id)."""

    node: int
    keys: list[str]
    goal: float
    slack: float
    left: int
    right: int
    at: int = 0
    low: int = 0
    high: int = 0
    below: float = 0.0
    cut: tuple | None = None
    fixed: tuple = ()


def kd_leaves(rows: DataFrame, dims: list[str], tie: str, row_id: str, weight: str, leaves: int, tolerance: float = 0.005) -> DataFrame:
    """Add ``leaf`` (0 to ``leaves`` - 1): leaves of a K-d tree of near equal summed ``weight``.

    ``dims``, ``tie``, ``row_id`` are non-null long columns, ``weight`` is positive.
    A node that is to give k leaves is cut along its widest dimension (extent over
    the extent of the whole table) where k // 2 of its k shares of weight lie below.
    The cut is found by radix search: histograms of at most 1024 bins a node, summed
    by Spark, narrow it until it is within ``tolerance`` of a leaf's weight.  A cut
    goes between two values of the dimension if one is near enough, else between two
    values of ``tie``, else between two ``row_id``; so rows that agree in ``dims`` and
    ``tie`` (equal texts) stay together unless they outweigh the tolerance.
    The driver holds at most 1024 bins for each node of a level.
    """
    spark = rows.sparkSession
    base = write_table(rows.withColumn("leaf", F.lit(0).cast("long")), "kd")
    total = base.agg(F.sum(weight)).first()[0] or 0
    nodes = {0: (0, leaves)}  # node -> (first leaf, number of leaves)
    extents: dict[str, float] = {}
    slack = tolerance * total / max(leaves, 1)
    while any(k > 1 for _, k in nodes.values()) and total:
        spread = base.groupBy("leaf").agg(
            F.sum(weight).alias("w"), *[f(d).alias(f"{n}_{d}") for d in [*dims, tie, row_id] for n, f in (("min", F.min), ("max", F.max))]
        )
        stats = {r["leaf"]: r for r in spread.collect()}
        if not extents:
            extents = {d: float(stats[0][f"max_{d}"] - stats[0][f"min_{d}"]) or 1.0 for d in dims}
        splits, after = [], {}
        for node, (first, k) in nodes.items():
            if k == 1 or node not in stats:
                after[node] = (first, 1 if node not in stats else k)
                continue
            s, half = stats[node], k // 2
            widest = max(dims, key=lambda d: (s[f"max_{d}"] - s[f"min_{d}"]) / extents[d])
            split = _Split(node, [widest, tie, row_id], s["w"] * half / k, slack, first, first + half)
            split.low, split.high = s[f"min_{widest}"], s[f"max_{widest}"]
            splits.append(split)
            after[first], after[first + half] = (first, half), (first + half, k - half)
        if not splits:
            break
        _search(spark, base, splits, dims, weight)
        table = spark.createDataFrame([(s.node, dims.index(s.keys[0]), *s.cut, s.left, s.right) for s in splits], "n long, d int, c0 long, c1 long, c2 long, l long, r long")
        first_key = F.element_at(F.array(*[F.col(d) for d in dims]), F.col("d") + 1)
        lower = F.struct(first_key.alias("x"), F.col(tie).alias("y"), F.col(row_id).alias("z")) <= F.struct(F.col("c0").alias("x"), F.col("c1").alias("y"), F.col("c2").alias("z"))
        # One row for each node of this level, as many as leaves at most.
        moved = base.join(F.broadcast(table), base["leaf"] == table["n"], "left")
        base = write_table(moved.withColumn("leaf", F.when(F.col("n").isNull(), F.col("leaf")).when(lower, F.col("l")).otherwise(F.col("r"))).select(*base.columns), "kd")
        nodes = after
    return base


_MAX = (1 << 63) - 1


def _search(spark, base: DataFrame, splits: list[_Split], dims: list[str], weight: str) -> None:
    """Fill in ``cut`` of each split: rows whose (dimension, tie, row id) is at most ``cut`` go left."""
    tie, row_id = splits[0].keys[1:]
    first_key = F.element_at(F.array(*[F.col(d) for d in dims]), F.col("d") + 1)
    x = F.when(F.col("at") == 0, first_key).when(F.col("at") == 1, F.col(tie)).otherwise(F.col(row_id))
    while open_splits := [s for s in splits if s.cut is None]:
        state = spark.createDataFrame(
            [(i, s.node, dims.index(s.keys[0]), s.at, s.low, s.high, Decimal(max(1, -(-(s.high - s.low + 1) // _BINS))), *[*s.fixed, None, None][:2]) for i, s in enumerate(open_splits)],
            "i int, n long, d int, at int, lo long, hi long, width decimal(20,0), f0 long, f1 long",
        )
        # One row for each node of this level, as many as leaves at most.
        active = base.join(F.broadcast(state), base["leaf"] == state["n"]).withColumn("x", x)
        active = active.where(F.col("x").between(F.col("lo"), F.col("hi")) & ((F.col("at") < 1) | (first_key == F.col("f0"))) & ((F.col("at") < 2) | (F.col(tie) == F.col("f1"))))
        bin_ = F.floor((F.col("x").cast("decimal(20,0)") - F.col("lo")) / F.col("width")).cast("int")
        found = active.groupBy("i", bin_.alias("bin")).agg(F.sum(weight).alias("w"), F.min("x").alias("lo"), F.max("x").alias("hi")).collect()
        for i, s in enumerate(open_splits):
            _narrow(s, sorted((r["bin"], float(r["w"]), r["lo"], r["hi"]) for r in found if r["i"] == i))


def _narrow(s: _Split, bins: list[tuple]) -> None:
    below = s.below
    for _, w, lo, hi in bins:
        if below + w >= s.goal:
            over, under = below + w - s.goal, s.goal - below
            if min(over, under) <= s.slack or hi == lo and s.at == 2:
                s.cut = _cut(s, hi if over <= under else lo - 1)
            elif hi > lo:
                s.low, s.high, s.below = lo, hi, below
            else:  # one value outweighs the tolerance: search among its rows by the next key
                s.fixed, s.at, s.below = (*s.fixed, lo), s.at + 1, below
                s.low, s.high = -_MAX - 1, _MAX
            return
        below += w
    s.cut = _cut(s, bins[-1][3])  # rounding of sums: all rows are below


def _cut(s: _Split, value: int) -> tuple:
    return (*s.fixed, value, *[_MAX] * (2 - s.at))


def text_metadata(text: Column) -> dict[str, Column]:
    """Dimensions that depend on the text alone, so that copies of a text share them: bytes, share of
    multi-byte characters in millionths, line breaks."""
    whole = F.coalesce(text, F.lit(""))
    size, chars = F.octet_length(whole).cast("long"), F.length(whole).cast("long")
    return {
        "bytes": size,
        "multibyte": F.when(size == 0, F.lit(0)).otherwise(F.floor((size - chars) * 1000000 / size)).cast("long"),
        "breaks": (chars - F.length(F.translate(whole, "\n", ""))).cast("long"),
    }


def shard_documents(docs: DataFrame, shards: int | None = 16, target_bytes: int | None = None) -> DataFrame:
    """Shard ``docs`` (doc_id, text) by a K-d tree over text metadata.

    Give the number of shards, or ``target_bytes`` of a shard.  Returns doc_id, size
    (UTF-8 bytes of the text + 1), text_crc32, shard, slot (gapless in each shard, by
    doc_id).  A null text counts as empty.  Rows with a null doc_id are kept (they are
    ordered as -1).  Repeated rows are placed one by one.  An empty table gives none.
    """
    text = docs["text"]
    meta = {f"_d_{k}": v for k, v in text_metadata(text).items()}
    whole = F.coalesce(text, F.lit(""))
    rows = docs.select(
        docs["doc_id"].alias("doc_id"),
        (F.octet_length(whole) + 1).cast("long").alias("size"),
        F.crc32(F.encode(whole, "UTF-8")).cast("long").alias("text_crc32"),
        F.xxhash64(whole).alias("_tie"),
        F.coalesce(docs["doc_id"].cast("long"), F.lit(-1)).alias("_id"),
        *[v.alias(k) for k, v in meta.items()],
    )
    if target_bytes is not None:
        rows = write_table(rows, "meta")
        shards = max(1, -(-int(rows.agg(F.sum("size")).first()[0] or 0) // target_bytes))
    leaves = kd_leaves(rows, list(meta), "_tie", "_id", "size", shards)
    placed = leaves.select("doc_id", "size", "text_crc32", F.col("leaf").cast("int").alias("shard"), "_id")
    return number_within(placed, ["shard"], ["_id", "text_crc32"], "slot").drop("_id")
