"""Sequence packing as a cutting-stock problem, solved by column generation."""

from __future__ import annotations

import json
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.workspace import write_table
from ..operators.ranking import number_within

#: How the byte-level splitter of this kind of tokenizer cuts text (its published pattern).
_SPLIT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters on whose classes all Unicode versions agree; texts with others go to the library that the file is for.
_PLAIN = re.compile("[\t\n\r\x20-\x7e¡-¬®-įı-ž]*")


class TextIds:
    """Token ids of texts by a byte-level BPE file, as the tokenizers library gives them.

    Plain texts are encoded by tiktoken from the same vocabulary, several times
    faster; special strings are read as that library does, as their own ids.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        from .token_counts import byte_chars

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if spec["pre_tokenizer"].get("type") != "ByteLevel" or not spec["pre_tokenizer"].get("use_regex") or spec["normalizer"]:
            raise ValueError("not a byte-level BPE file")
        self._library = Tokenizer.from_file(path)
        self._library.no_truncation()
        self._library.no_padding()
        code = {c: b for b, c in byte_chars().items()}
        special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        ranks = {bytes(code[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
        self._fast = tiktoken.Encoding("plain", pat_str=_SPLIT, mergeable_ranks=ranks, special_tokens=special)

    def __call__(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, np.uint32)
        if _PLAIN.fullmatch(text):
            return self._fast.encode_to_numpy(text, allowed_special="all")
        return np.array(self._library.encode(text, add_special_tokens=False).ids, np.uint32)


_LOADED: dict[str, TextIds] = {}


def text_ids(path: str) -> TextIds:
    """The encoder of a file, loaded once in a process."""
    if path not in _LOADED:
        _LOADED[path] = TextIds(path)
    return _LOADED[path]


def cut_documents(docs: DataFrame, path: str, capacity: int = 1024) -> DataFrame:
    """Pieces of at most ``capacity`` ids: doc_id, start, length, ids_crc32, doc_tokens.

    A document is its text's ids and a closing id 0; a null or empty text is the
    closing id alone.  It is cut into full pieces and a rest; a rest over half the
    capacity gives up half a sequence first, as long rests only leave gaps that the
    short ones don't suffice to fill.
    """
    half = capacity // 2

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = text_ids(path)
        for batch in batches:
            doc, start, length, crc, tokens = [], [], [], [], []
            for d, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                ids = np.append(encode(t), np.uint32(0)).astype("<u4")
                cuts = [*range(0, len(ids), capacity), len(ids)]
                if cuts[-1] - cuts[-2] not in (capacity, half) and cuts[-1] - cuts[-2] > half:
                    cuts.insert(-1, cuts[-2] + half)
                for s, e in zip(cuts, cuts[1:]):
                    part = ids[s:e]
                    doc.append(d)
                    start.append(s)
                    length.append(len(part))
                    crc.append(zlib.crc32(part.tobytes()))
                    tokens.append(len(ids))
            arrays = [pa.array(doc, batch.schema.field("doc_id").type), *[pa.array(x, pa.int64()) for x in (start, length, crc, tokens)]]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(cut, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long")


Pattern = tuple[tuple[int, int], ...]


def _price(lengths: np.ndarray, duals: np.ndarray, capacity: int) -> tuple[float, dict[int, int]]:
    """The pattern of largest dual value that fits (unbounded knapsack by dynamic programming)."""
    best, pick = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    worth = np.flatnonzero(duals > 1e-12)
    ls, ds = lengths[worth], duals[worth]
    for c in range(1, capacity + 1):
        n = int(np.searchsorted(ls, c, "right"))
        best[c] = best[c - 1]
        if n:
            values = best[c - ls[:n]] + ds[:n]
            if values[k := int(values.argmax())] > best[c] + 1e-15:
                best[c], pick[c] = values[k], worth[k]
    used: dict[int, int] = {}
    c = capacity
    while c > 0:
        if pick[c] < 0:
            c -= 1
        else:
            used[int(pick[c])] = used.get(int(pick[c]), 0) + 1
            c -= int(lengths[pick[c]])
    return float(best[capacity]), used


def _inverse(basis: np.ndarray) -> np.ndarray:
    """By Gauss-Jordan steps: few rows, and no linear algebra threads beside the JVM's."""
    n = len(basis)
    work = np.hstack([basis, np.eye(n)])
    for j in range(n):
        k = j + int(np.abs(work[j:, j]).argmax())
        work[[j, k]] = work[[k, j]]
        work[j] /= work[j, j]
        factor = work[:, j].copy()
        factor[j] = 0
        work -= factor[:, None] * work[j]
    return work[:, n:]


def solve_relaxation(demand: dict[int, int], capacity: int, gap: float = 1e-3, rounds: int = 20_000) -> list[tuple[Pattern, float]]:
    """Patterns with (fractional) uses that cover ``demand`` (length -> pieces), by revised simplex and column generation.

    Columns are priced by a knapsack over the duals; it ends when the objective is
    within ``gap`` of the bound objective / best price, or no column improves it.
    """
    lengths = np.array(sorted(demand))
    need = np.array([float(demand[x]) for x in lengths])
    m = len(lengths)
    if not m:
        return []
    fit = capacity // lengths
    columns: list[dict[int, int]] = [{i: int(fit[i])} for i in range(m)]
    inverse, x = np.diag(1.0 / fit), need / fit
    for step in range(rounds):
        duals = inverse.sum(0)
        price, used = _price(lengths, duals, capacity)
        if price <= 1 + 1e-9 or x.sum() * (1 - 1 / price) <= gap * x.sum():
            break
        u = sum(inverse[:, i] * n for i, n in used.items())
        grows = u > 1e-9
        ratio = np.where(grows, x / np.where(grows, u, 1), np.inf)
        out = int(ratio.argmin())
        t = ratio[out]
        x = np.maximum(x - t * u, 0)
        x[out] = t
        row = inverse[out] / u[out]
        inverse -= np.outer(u, row)
        inverse[out] = row
        columns[out] = used
        if step % 500 == 499:  # rounding errors don't add up
            basis = np.zeros((m, m))
            for j, c in enumerate(columns):
                for i, n in c.items():
                    basis[i, j] = n
            inverse = _inverse(basis)
            x = np.maximum(inverse @ need, 0)
    return [(tuple(sorted((int(lengths[i]), n) for i, n in c.items())), float(v)) for c, v in zip(columns, x) if v > 1e-9]


def round_patterns(relaxed: list[tuple[Pattern, float]], demand: dict[int, int], capacity: int) -> list[tuple[Pattern, int]]:
    """Whole uses of patterns that cover ``demand`` exactly: uses rounded down, and what is left packed best fit first."""
    left = dict(demand)
    out: Counter = Counter()
    for pattern, uses in relaxed:
        n = int(uses + 1e-6)
        n = min([n, *[left[x] // k for x, k in pattern]])
        if n:
            out[pattern] += n
            for x, k in pattern:
                left[x] -= n * k
    bins: list[list[list[int]]] = [[] for _ in range(capacity + 1)]  # by free space
    for x in sorted(left, reverse=True):
        for _ in range(left[x]):
            free = next((f for f in range(x, capacity + 1) if bins[f]), None)
            items = bins[free].pop() if free is not None else []
            bins[(capacity if free is None else free) - x].append([*items, x])
    for items in (i for b in bins for i in b):
        out[tuple(sorted(Counter(items).items()))] += 1
    return sorted(out.items())


def plan_sequences(demand: dict[int, int], capacity: int, gap: float = 1e-3) -> list[tuple[int, int, int, int, int, int]]:
    """Where ranked pieces go: (size, first rank, pieces, copies in a sequence, first sequence, slot).

    Rank r of a size, in the row with first <= r < first + pieces, goes to sequence
    ``first sequence + (r - first) // copies``, slot ``slot + (r - first) % copies``.
    There are at most some thousand rows, however many pieces there are.
    """
    whole = demand.get(capacity, 0)
    small = {x: n for x, n in demand.items() if x < capacity}
    rows = [(capacity, 0, whole, 1, 0, 0)] if whole else []
    sequence, placed = whole, Counter()
    for pattern, uses in round_patterns(solve_relaxation(small, capacity, gap), small, capacity):
        slot = 0
        for x, k in sorted(pattern, reverse=True):
            rows.append((x, placed[x], uses * k, k, sequence, slot))
            placed[x] += uses * k
            slot += k
        sequence += uses
    return rows


def pack_documents(docs: DataFrame, path: str, capacity: int = 1024, grid: int = 4, gap: float = 1e-3) -> DataFrame:
    """Pack ``docs`` (doc_id, text) into sequences of at most ``capacity`` ids.

    Returns a row for each piece: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id (0, 1, ...), offset.  The histogram of piece sizes (lengths in steps of
    ``grid``, rounded up: at most capacity / grid numbers) comes to the driver; a linear
    program over patterns gives how often each is used; pieces of a size are ranked by
    doc_id and start and take the places of that size in turn.  Repeated rows are packed
    one by one; an empty table gives no sequence.
    """
    if capacity % grid:
        raise ValueError("capacity must be a multiple of grid")
    spark = docs.sparkSession
    size = F.ceil(F.col("length") / grid).cast("long")
    pieces = write_table(cut_documents(docs, path, capacity).withColumn("size", size), "pieces")
    demand = {r["size"]: r["n"] for r in pieces.groupBy("size").agg(F.count(F.lit(1)).alias("n")).collect()}
    slots = spark.createDataFrame(plan_sequences(demand, capacity // grid, gap), "_size long, first long, n long, copies long, seq long, slot long")
    ranked = number_within(pieces, ["size"], ["doc_id", "start", "ids_crc32"], "rank")
    place = F.col("rank") - F.col("first")
    on = (F.col("size") == F.col("_size")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("first") + F.col("n"))
    # Bounded by the number of patterns, which depends on ``capacity`` and ``grid`` only.
    joined = ranked.join(F.broadcast(slots), on)
    placed = joined.select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens",
        (F.col("seq") + F.floor(place / F.col("copies"))).cast("long").alias("sequence_id"),
        (F.col("slot") + place % F.col("copies")).alias("_slot"),
    )
    # A sequence has at most ``capacity`` pieces.
    before = Window.partitionBy("sequence_id").orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long")).drop("_slot")
