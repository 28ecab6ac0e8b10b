"""How text filters interact, for every order of applying them.

The last filter removes repeated texts, found by refining a partition: texts are
split by their number of code points, then by the hashes of successive blocks,
and what is alone in its class is dropped at once, so that only texts with a
likely copy are read again.  The full texts of what is left are compared.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.workspace import write_table
from .line_dedup import may_hold

FILTERS = "ABCDE"
REPEATED = 16
#: First code point and length of the blocks whose hashes refine the classes.
BLOCKS = ((1, 64), (65, 4032), (4097, 2**31 - 1))
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def text_failures(text: Column, few: int = 200, distinct_share: int = 50, capitals_share: int = 2, marks: str = "[#$%&*|]") -> Column:
    """Bits of the filters that a text (not null) fails by itself: 1 under ``few`` words, 2 less than ``distinct_share``
    percent of its words are distinct, 4 over ``capitals_share`` percent A-Z, 8 a character of ``marks``.

    Words are runs without ASCII white space.  A text without words fails the first only.
    """
    words = F.array_remove(F.split(text, "[\\x20\\x09-\\x0D]+"), "")
    capitals = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    bit = lambda fails, b: F.when(fails, b).otherwise(0)
    return (
        bit(F.size(words) < few, 1) + bit(100 * F.size(F.array_distinct(words)) < distinct_share * F.size(words), 2)
        + bit(100 * capitals.cast("long") > capitals_share * F.length(text), 4) + bit(text.rlike(marks), 8)
    )


def digest(key: Column, piece: Column, step: int) -> Column:
    """The class that a piece of text leads to from a class."""
    return F.xxhash64(key, piece, F.lit(step))


def repeated_texts(docs: DataFrame, columns: dict[str, Column], hashed: Callable[[Column, Column, int], Column] = digest) -> DataFrame:
    """doc_id and ``columns`` of each row of ``docs`` (doc_id, text; null: empty) whose text some smaller doc_id has too.

    A row with a null doc_id is neither smaller nor larger than others.  Each round scans ``docs`` and lets only rows
    pass whose class may still have another (a bitmap of fixed size tells); classes are counted with map-side
    combine, so copies of one text are few rows.  At the end the full texts of each class are compared: should two
    texts agree in all hashes, another hash of the whole splits them and they are compared again.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", text.alias("_t"), *[c.alias(name) for name, c in columns.items()])
    size = F.length("_t").cast("long")
    shared = lambda keys: write_table(keys.groupBy("_key").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_key"), "classes")
    classes, key, done = shared(docs.select(F.length(text).cast("long").alias("_key"))), size, 0
    while True:
        found = may_hold(rows.withColumn("_class", key), "_class", classes)
        if done >= len(BLOCKS):
            # Equal texts of a class become one row where they are read.
            texts = found.select("_class", "_t").distinct().groupBy("_class").agg(F.count(F.lit(1)).alias("_n"))
            if texts.where("_n > 1").isEmpty():
                break
            piece = F.col("_t")
        else:
            piece = F.substring("_t", *BLOCKS[done])
        key = hashed(key, piece, done)
        classes = shared(found.select(hashed(F.col("_class"), piece, done).alias("_key")))
        done += 1
    held = write_table(found.select("_class", "doc_id", *columns), "survivors")
    first = held.groupBy(F.col("_class").alias("_c")).agg(F.min("doc_id").alias("_first"))
    # By class and doc_id: rows of the largest group of copies are dealt like any others.
    repeats = held.where("doc_id IS NOT NULL").join(first, (F.col("_class") == F.col("_c")) & (F.col("doc_id") == F.col("_first")), "left_anti")
    return repeats.select("doc_id", *columns)


def failure_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, good, toxic, n: rows of ``docs`` (doc_id, text, source) by source (null: empty string), the filters
    they fail (bit 0 for A to bit 4 for E) and whether ``labels`` (doc_id, quality, toxic) has them with quality 1 or toxic 1.

    A null text is empty; a null doc_id has no label; of repeated labels any counts.
    """
    text = F.coalesce("text", F.lit(""))
    columns = {"part": F.coalesce(F.col("source").cast("string"), F.lit("")), "mask": text_failures(text)}
    every = docs.select("doc_id", *[c.alias(name) for name, c in columns.items()])
    again = repeated_texts(docs, columns)
    # A repeated row counts once without E, once less for that, and once with E.
    signed = every.withColumn("n", F.lit(1)).union(again.withColumn("n", F.lit(-1))).union(again.withColumn("mask", F.col("mask") + REPEATED).withColumn("n", F.lit(1)))
    own = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("_id")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    flag = lambda c: F.coalesce(c, F.lit(False)).alias(c)
    rows = signed.groupBy("doc_id", "part", "mask").agg(F.sum("n").alias("n")).where("n <> 0")
    marked = rows.join(own, rows["doc_id"] == own["_id"], "left").select("part", "mask", flag("good"), flag("toxic"), "n")
    return marked.groupBy("part", "mask", "good", "toxic").agg(F.sum("n").alias("n"))


def orders_sql() -> str:
    """SQL of a generator of filter_order, step, bit (of the step's filter) and before (bits of the filters before it)."""
    rows = []
    for order in itertools.permutations(FILTERS):
        bits = [1 << FILTERS.index(f) for f in order]
        rows += [f"named_struct('filter_order', '{''.join(order)}', 'step', {i + 1}, 'bit', {b}, 'before', {sum(bits[:i])})" for i, b in enumerate(bits)]
    return f"inline(array({', '.join(rows)}))"


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step, filter and ``COUNTS`` for each source, each order of the five filters and each step.

    kept: left after the step; removed: by the step; redundant: fail its filter but are gone; unique_fails: fail
    no other filter; good_lost, toxic_lost: removed with such a label; shapley: removed by the filter over all
    orders.  An empty table gives no rows.
    """
    counts = failure_counts(docs, labels)
    masks = range(1 << len(FILTERS))
    # 32 numbers of each kind a source, whatever the rows.
    of = lambda keep: F.array(*[F.coalesce(F.sum(F.when((F.col("mask") == m) & keep, F.col("n"))), F.lit(0)) for m in masks])
    by_part = write_table(counts.groupBy("part").agg(of(F.lit(True)).alias("rows"), of(F.col("good")).alias("goods"), of(F.col("toxic")).alias("toxics")), "masks")
    steps = by_part.select("part", "rows", "goods", "toxics", F.expr(orders_sql()))
    own = lambda m: m.bitwiseAND(F.col("bit")) != 0
    gone = lambda m: m.bitwiseAND(F.col("before")) != 0
    total = lambda values, keep: F.aggregate(F.transform(values, lambda v, m: F.when(keep(m), v).otherwise(0)), F.lit(0).cast("long"), lambda a, v: a + v)
    # Of k filters that a row fails, each comes first in 120 / k of the orders.
    turns = F.transform("rows", lambda v, m: F.when(m == 0, 0).otherwise((v * F.lit(120) / F.bit_count(m)).cast("long")))
    return steps.select(
        "part", "filter_order", "step", F.substring("filter_order", F.col("step"), F.lit(1)).alias("filter"),
        total("rows", lambda m: ~own(m) & ~gone(m)).alias("kept"), total("rows", lambda m: own(m) & ~gone(m)).alias("removed"),
        total("rows", lambda m: own(m) & gone(m)).alias("redundant"), total("rows", lambda m: m == F.col("bit")).alias("unique_fails"),
        total("goods", lambda m: own(m) & ~gone(m)).alias("good_lost"), total("toxics", lambda m: own(m) & ~gone(m)).alias("toxic_lost"),
        total(turns, own).alias("shapley"),
    )
