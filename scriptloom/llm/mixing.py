"""Mixing sources by temperature: token shares to a power, budgets, block permutations."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.workspace import write_table
from ..operators.ranking import sum_before


#: Sources up to which the table of their budgets is broadcast.
BROADCAST_SOURCES = 100_000


def token_estimate(text: Column) -> Column:
    """Words of a text by white space; 0 if it has none."""
    trimmed = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    return F.when(trimmed == "", 0).otherwise(F.length(trimmed) - F.length(F.translate(trimmed, " ", "")) + 1).cast("long")


def counted(slim: DataFrame, path: str) -> DataFrame:
    """``slim`` (doc_id, text_key, source, text) with n_tokens in place of its text: tokens by the tokenizer file ``path``, 0 for null."""
    from .packing import text_ids

    names = ["doc_id", "text_key", "source", "n_tokens"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = text_ids(path)
        for batch in batches:
            n = pa.array([len(encode(t)) for t in batch.column("text").to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names[:3]], n], names=names)

    kind = slim.schema["doc_id"].dataType.simpleString()
    return slim.select(*names[:3], "text").mapInArrow(count, f"doc_id {kind}, text_key long, source string, n_tokens long")


def temper(shares: dict, exponent: float) -> dict:
    """Shares to the power of ``exponent``, normalised (in logarithms, so that none underflows)."""
    logs = {k: exponent * math.log(v) for k, v in shares.items() if v > 0}
    if not logs:
        return {}
    top = max(logs.values())
    total = math.fsum(math.exp(x - top) for x in logs.values())
    return {k: math.exp(x - top) / total for k, x in logs.items()}


def entropy(weights: dict) -> float:
    """In bits."""
    return -math.fsum(w * math.log2(w) for w in weights.values() if w > 0)


def repetition(tokens: dict, weights: dict, budget: float | None) -> float:
    """Times that the most repeated source is read; without a budget, when each source is read once at least."""
    rates = [w / tokens[k] for k, w in weights.items()]
    return max(rates) * (budget if budget is not None else 1 / min(rates))


def find_exponent(tokens: dict, target_entropy: float | None = None, repetition_limit: float | None = None, budget: float | None = None, steps: int = 60) -> float:
    """The exponent in 0..1 (1: shares as they are, 0: equal) that meets the target, by bisection.

    With ``target_entropy`` (bits) the largest whose weights have that entropy at least;
    with ``repetition_limit`` the smallest at which no source is read more often.
    A target out of reach gives the nearer end.
    """
    if (target_entropy is None) == (repetition_limit is None):
        raise ValueError("give either target_entropy or repetition_limit")
    used = {k: v for k, v in tokens.items() if v > 0}
    if len(used) < 2:
        return 1.0
    total = sum(used.values())
    shares = {k: v / total for k, v in used.items()}
    low, high = 0.0, 1.0
    flat = (lambda a: entropy(temper(shares, a)) >= target_entropy) if target_entropy is not None else (lambda a: repetition(used, temper(shares, a), budget) > repetition_limit)
    # ``flat`` holds up to some exponent and not beyond it.
    if not flat(low):
        return low
    if flat(high):
        return high
    for _ in range(steps):
        middle = (low + high) / 2
        low, high = (middle, high) if flat(middle) else (low, middle)
    return low if target_entropy is not None else high


def schedule(
    docs: DataFrame, tokenizer: str | None = None, target_entropy: float | None = None, repetition_limit: float | None = None,
    budget_tokens: int | None = None, block_tokens: int = 1 << 18, seed: int = 0,
) -> DataFrame:
    """When each row of ``docs`` (doc_id, text, source) is read: doc_id, text_key, source, n_tokens, epoch, place.

    Tokens are counted by the byte-level BPE file ``tokenizer``, or as words if there is none.
    Sources get weights by temperature (``find_exponent``) and budgets in tokens by
    weight; without ``budget_tokens`` the smallest budget that reads every source once
    (with it, sources may be read in part).  A source's documents lie in blocks of about
    ``block_tokens`` by a hash.  In each epoch its blocks are read in another random order
    (``place``: where a block stands in it); the last epoch stops at the budget, in a
    block at the first document that begins beyond it.  A row is returned for each
    reading.  A null source is a source of its own.  A document without tokens is read
    whenever its block is; a source that has none at all once.  Rows that repeat doc_id
    and text (null doc_ids too) are one document: all of them are read, or none.  An empty
    table has no readings.  One row for each source comes to the driver.
    """
    spark = docs.sparkSession
    slim = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key"), F.col("source").cast("string").alias("source"), "text")
    slim = counted(slim, tokenizer) if tokenizer else slim.withColumn("n_tokens", token_estimate(F.col("text"))).drop("text")
    slim = write_table(slim, "mix")
    totals = {r["source"]: r["n"] for r in slim.groupBy("source").agg(F.sum("n_tokens").alias("n")).collect()}
    used = {k: v for k, v in totals.items() if v}
    exponent = find_exponent(used, target_entropy, repetition_limit, budget_tokens)
    total = sum(used.values()) or 1
    weights = temper({k: v / total for k, v in used.items()}, exponent)
    budget = budget_tokens if budget_tokens is not None else (1 / min(w / used[k] for k, w in weights.items()) if weights else 0)
    plan = []
    for k, v in totals.items():
        share = int(weights[k] * budget * (1 + 1e-12) + 1e-6) if v else 0
        plan.append((k, share // v if v else 1, share % v if v else 0, max(1, -(-v // block_tokens))))
    sources = spark.createDataFrame(plan, "_source string, full int, rest long, blocks long")
    # A row a source, which the driver holds anyway; a hot source stays where it is read.
    few = F.broadcast(sources) if len(plan) <= BROADCAST_SOURCES else sources
    dealt = slim.join(few, slim["source"].eqNullSafe(sources["_source"])).drop("_source")
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("doc_id", "text_key", F.lit(seed)), F.col("blocks")))
    order = lambda epoch: F.xxhash64("source", "block", epoch, F.lit(seed))
    whole = dealt.where("full > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("full") - 1))).withColumn("place", order(F.col("epoch")))
    # The last epoch: blocks that begin before the budget ends; of the one in which it ends, the documents that do.
    partial = dealt.where("rest > 0").withColumn("place", order(F.col("full")))
    sums = partial.groupBy("source", "rest", "block", "place").agg(F.sum("n_tokens").alias("w"))
    begun = sum_before(sums, ["source"], ["place", "block"], "w", "before").where("before < rest")
    begun = begun.select(F.col("source").alias("_source"), F.col("block").alias("_block"), "before", "w")
    reads = partial.join(begun, partial["source"].eqNullSafe(begun["_source"]) & (partial["block"] == begun["_block"]))
    inside = reads.where("before + w <= rest")
    edge = reads.where("before + w > rest").withColumn("_h", F.xxhash64("doc_id", "text_key", "full", F.lit(seed + 1)))
    # One block of each source at most; rows that repeat a document are one in it.
    whole_docs = edge.groupBy("source", "rest", "before", "_h", "doc_id", "text_key").agg(F.sum("n_tokens").alias("n_tokens"))
    read = sum_before(whole_docs, ["source"], ["_h", "doc_id"], "n_tokens", "_within").where("before + _within < rest")
    read = read.select(F.col("source").alias("_s"), F.col("doc_id").alias("_d"), F.col("text_key").alias("_t"))
    edge = edge.join(read, edge["source"].eqNullSafe(read["_s"]) & edge["doc_id"].eqNullSafe(read["_d"]) & (edge["text_key"] == read["_t"]), "left_semi")
    columns = ["doc_id", "text_key", "source", "n_tokens", "epoch", "place"]
    last = inside.withColumn("epoch", F.col("full")).select(*columns).union(edge.withColumn("epoch", F.col("full")).select(*columns))
    return whole.select(*columns).union(last)


def mix(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with each row as often as ``schedule`` reads it (its columns only; rows that it never reads go).

    Rows that repeat doc_id, text and source are read equally often, so none of ``schedule``'s
    readings is lost.  Columns may have any names; an empty table gives an empty one.
    """
    readings = schedule(docs, **options).groupBy("doc_id", "text_key", "source").agg(F.count(F.lit(1)).alias("_n"))
    packed = docs.select(F.struct("*").alias("row"), "doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("key"), F.col("source").cast("string").alias("src"))
    same = packed.groupBy(F.col("doc_id").alias("_doc"), F.col("key").alias("_text"), F.col("src").alias("_src")).agg(F.count(F.lit(1)).alias("_rows"))
    per_row = readings.join(same, readings["doc_id"].eqNullSafe(same["_doc"]) & (readings["text_key"] == same["_text"]) & readings["source"].eqNullSafe(same["_src"]))
    per_row = per_row.select("_doc", "_text", "_src", (F.col("_n") / F.col("_rows")).cast("int").alias("times"))
    on = packed["doc_id"].eqNullSafe(per_row["_doc"]) & (packed["key"] == per_row["_text"]) & packed["src"].eqNullSafe(per_row["_src"])
    read = packed.join(per_row, on).where("times > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("time"))
    return read.select(*[F.col("row")[c].alias(c) for c in docs.columns])
