"""Exact order statistics of many columns at once, by radix selection.

A double's bits, turned so that they sort as whole numbers do, are looked at some
at a time from the top.  A pass counts the next bits of the cells that share the
bits known so far of a wanted value; the counts say which come next.  Rows stay
wide and where they are: nothing is exploded, sorted or exchanged but counts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.workspace import write_table
from .splits import sums_by_key

#: Bits that the passes look at.
DIGITS = (13, 13, 13, 13, 12)
_TOP = np.uint64(1 << 63)


def ordered_bits(values: np.ndarray) -> np.ndarray:
    """Doubles as unsigned whole numbers of the same order; -0 is 0, NaN the largest."""
    values = np.where(np.isnan(values), np.nan, values) + 0.0
    bits = values.view(np.uint64)
    return np.where(bits & _TOP, ~bits, bits | _TOP)


def from_bits(keys: np.ndarray) -> np.ndarray:
    return np.where(keys & _TOP, keys ^ _TOP, ~keys).view(np.float64)


def numbers(df: DataFrame, columns: list[str], stored: bool = False) -> DataFrame:
    """``columns`` as doubles c0, c1, ... (null: 0), written once for all passes unless ``df`` is ``stored``, a plain scan of files."""
    wide = df.select(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(f"c{i}") for i, c in enumerate(columns)])
    return wide if stored else write_table(wide, "numbers")


def _counts(table: DataFrame, known: list[np.ndarray], used: int, digit: int) -> dict[int, np.ndarray]:
    """For each column and each of its ``known`` beginnings of ``used`` bits, how often each of the next ``digit`` bits comes,
    and how often with no bits set behind them."""
    bins = 1 << digit
    wanted = [i for i, k in enumerate(known) if len(k)]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = {i: np.zeros((2, len(known[i]) * bins), np.int64) for i in wanted}
        for batch in batches:
            for i in wanted:
                begun = known[i]
                keys = ordered_bits(batch.column(i).to_numpy())
                slot = np.zeros(len(keys), np.int64)
                if used:
                    begins = keys >> np.uint64(64 - used)
                    slot = np.minimum(np.searchsorted(begun, begins), len(begun) - 1)
                    same = begun[slot] == begins
                    keys, slot = keys[same], slot[same]
                rest = np.uint64(64 - used - digit)
                place = slot * bins + (keys >> rest & np.uint64(bins - 1)).astype(np.int64)
                bare = keys & (np.uint64(1) << rest) - np.uint64(1) == 0
                totals[i] += [np.bincount(p, minlength=len(begun) * bins) for p in (place, place[bare])]
        yield pa.RecordBatch.from_arrays([pa.array(wanted, pa.int64()), pa.array([t.ravel() for t in totals.values()], pa.list_(pa.int64()))], names=["key", "values"])

    return sums_by_key(table.mapInArrow(count, "key long, values array<long>"))


def order_statistics(table: DataFrame, columns: int, ranks: Callable[[int], list[int]]) -> list[list[float]]:
    """Of each of the ``columns`` of ``numbers`` the values at the 1-based ranks that ``ranks`` gives for so many rows; none of an empty table.

    A value is known once all cells that share its bits so far have no others set: whole numbers take two passes.
    """
    known = [np.zeros(1, np.uint64)] * columns
    values: list[np.ndarray] = []
    used = 0
    for digit in DIGITS:
        found = _counts(table, known, used, digit)
        if not used:
            n = int(found[0][: 1 << digit].sum()) if found else 0
            if not n:
                return []
            left = [np.array(ranks(n), np.int64) for _ in range(columns)]
            slots = [np.zeros(len(r), np.int64) for r in left]
            values = [np.zeros(len(r), np.uint64) for r in left]
        used += digit
        for i, counts in found.items():
            counts, bare = counts.reshape(2, len(known[i]), -1)
            upto = np.cumsum(counts, axis=1)
            begins = np.zeros(len(left[i]), np.uint64)
            for k in np.flatnonzero(slots[i] >= 0):
                s = slots[i][k]
                at = int(np.searchsorted(upto[s], left[i][k]))
                left[i][k] -= upto[s, at - 1] if at else 0
                begins[k] = known[i][s] << np.uint64(digit) | np.uint64(at)
                if used == 64 or counts[s, at] == bare[s, at]:
                    values[i][k] = begins[k] << np.uint64(64 - used) if used < 64 else begins[k]
                    slots[i][k] = -1
            open_ = slots[i] >= 0
            known[i], places = np.unique(begins[open_], return_inverse=True)
            slots[i][open_] = places
        if not any(len(k) for k in known):
            break
    return [from_bits(v).tolist() for v in values]
