"""Fuzzy line deduplication: SimHash, pigeonhole blocks, edit similarity, components.

Within the few bits for which pigeonhole blocks of a SimHash are selective only a
quarter of the similar lines lie.  So the blocks are pieces of the lines themselves: the
two halves of a short line, and for longer lines the runs of bytes that come first
under each of eight orders (MinHash).  Lines that share one are candidates if their SimHashes,
over runs of four bytes, are within ``REACH``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.workspace import write_table
from .components import connected_components
from .minhash import COLUMNS, id_of, marks, met_units, mixed, posts_of, sketches, verified_links

#: ASCII characters other than letters and digits end a word; lines end at the line feed.
_BREAKS = bytes(c if c > 127 or chr(c).isalnum() or c == 10 else 32 for c in range(256))
#: Bits of the filter for lines that may need their text.
FILTER_BITS = 24
#: Lines under so many characters are marked by runs of SHORT_RUN bytes, others by runs of LONG_RUN, those that may be similar to both by both.
SHORT_CHARS, SHORT_RUN, LONG_RUN = 64, 6, 12
#: Columns of marks of either kind.
ORDERS = 8
#: Most bits between the SimHashes of lines that meet and are compared, by the marks that they share (0 to 8): by long runs, by
#: short ones (an edit turns more bits of so few runs), by halves (any number).
REACH = np.array([[0, 10, 16, 18, 18, 18, 18, 18, 18], [0, 14, 20, 26, 26, 26, 26, 26, 26], [64] * 9])
#: Classes of runs of three characters by which lines are compared before their edit distance is.
GRAM_CLASSES = 1024
#: Normalised bytes whose lines are made at a time (a longer text is one part), and lines that a task remembers to have posted.
PART_BYTES, SEEN_LINES = 1 << 15, 500_000


def normal_lines(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of the normalised lines of texts one after another, bytes of each line, and lines of each text.

    Words are runs of ASCII letters and digits and of other characters beyond ASCII, in
    lower case; a line is its words joined by a space.
    """
    whole = [t.lower().encode("utf-8", "surrogatepass") for t in texts]
    counts = np.array([t.count(b"\n") + 1 for t in whole], np.int64)
    data = np.frombuffer(b"\n".join(whole).translate(_BREAKS) + b"\n", np.uint8)
    blank = (data == 32) | (data == 10)
    # Of a run of spaces the first stays if a word is before it, and then if no line ends after it.
    keep = data != 32
    keep[1:] |= ~blank[:-1]
    data = data[keep]
    keep = np.ones(len(data), bool)
    keep[:-1] = (data[:-1] != 32) | (data[1:] != 10)
    data = data[keep]
    ends = np.flatnonzero(data == 10)
    sizes = np.diff(np.r_[-1, ends]) - 1
    return data[data != 10], sizes, counts


def runs_of_bytes(eight: np.ndarray, starts: np.ndarray, sizes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of ``width`` (4 to 16) bytes of lines that have as many at least, and where each line's begin.

    ``eight`` has at each byte that byte and the seven after it, as one number.
    """
    counts = sizes - (width - 1)
    first = np.cumsum(counts) - counts
    start, end = int(starts[0]), int(starts[-1] + counts[-1])
    if 2 * int(counts.sum()) >= end - start:
        # Where lines follow each other all bytes are hashed in their order, and those where a run begins stay.
        mark = np.zeros(end - start + 1, np.int8)
        mark[starts - start] = 1
        mark[starts + counts - start] = -1
        here = np.cumsum(mark[:-1], dtype=np.int8).view(bool)
        head, tail = eight[start : end + max(0, width - 8)], slice(max(0, width - 8), None)
    else:
        at = np.repeat(starts - first, counts) + np.arange(int(counts.sum()))
        head, here, tail = eight[at], slice(None), at + (width - 8)
    if width < 8:
        return mixed(head[here] & np.uint64((1 << (8 * width)) - 1)), first
    head = mixed(head)
    if width == 8:
        return head[here], first
    if isinstance(here, slice):
        rest = mixed(eight[tail])
    else:
        head, rest = head[: end - start], head[tail]
        head, rest = head[here], rest[here]
    rest *= np.uint64(3)
    rest += head
    return mixed(rest), first


def simhashes(grams: np.ndarray, first: np.ndarray) -> np.ndarray:
    """SimHash of each line's hashes, which begin at ``first``: a bit is 1 if over half of them have it.

    Every eighth bit is counted at a time, in the bytes of one number, over runs of up to 255 hashes.
    """
    sizes = np.diff(np.r_[first, len(grams)])
    runs = -(-sizes // 255)
    run_line = np.repeat(np.arange(len(sizes)), runs)
    run_first = np.cumsum(runs) - runs
    run_starts = first[run_line] + 255 * (np.arange(len(run_line)) - run_first[run_line])
    out = np.zeros(len(sizes), np.uint64)
    lanes = np.uint64(0x0101010101010101)
    for k in range(8):
        counts = np.add.reduceat(grams >> np.uint64(k) & lanes, run_starts).view(np.uint8).reshape(-1, 8)
        votes = np.add.reduceat(counts.astype(np.int32), run_first, axis=0) if len(run_line) > len(sizes) else counts.astype(np.int32)
        over = (2 * votes > sizes[:, None]).astype(np.uint8)
        out |= np.ascontiguousarray(over).view(np.uint64)[:, 0] << np.uint64(k)
    return out


def _shared(a: str, b: str) -> int:
    """Characters that a and b begin with alike."""
    i, n = 0, min(len(a), len(b))
    while i < n and a[i : i + 64] == b[i : i + 64]:
        i += 64
    while i < n and a[i] == b[i]:
        i += 1
    return min(i, n)


def _trimmed(a: str, b: str) -> tuple[str, str]:
    """a and b without what they share at their ends."""
    i = _shared(a, b)
    a, b = a[i:], b[i:]
    j = _shared(a[::-1], b[::-1])
    return a[: len(a) - j], b[: len(b) - j]


def edit_distance(a: str, b: str, most: int) -> int:
    """Levenshtein distance, or ``most`` + 1 if it is over ``most``; bit-parallel over whatever a and b don't share at their ends."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    a, b = _trimmed(a, b)
    if len(a) < len(b):
        a, b = b, a
    if not b:
        return min(len(a), most + 1)
    mask = (1 << len(a)) - 1
    last = 1 << (len(a) - 1)
    at: dict[str, int] = {}
    for k, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << k
    up, down, score, left = mask, 0, len(a), len(b)
    for c in b:
        x = at.get(c, 0) | down
        d = (((x & up) + up) ^ up) | x
        grow, drop = down | ~(d | up) & mask, up & d
        if grow & last:
            score += 1
        elif drop & last:
            score -= 1
        left -= 1
        if score - left > most:
            return most + 1
        grow = (grow << 1 | 1) & mask
        up = (drop << 1 & mask) | ~(d | grow) & mask
        down = grow & d
    return min(score, most + 1)


def similar(a: str, b: str, similarity: float) -> bool:
    """Whether 1 - edit distance / longer length is at least ``similarity``."""
    most = int((1 - similarity) * max(len(a), len(b)) + 1e-9)
    v, w = a.split(" "), b.split(" ")
    # Replacing word by word is one way to edit: if it is short enough the distance is.
    if len(v) == len(w) and sum(max(len(x), len(y)) for x, y in zip(v, w) if x != y) <= most:
        return True
    return edit_distance(a, b, most) <= most


#: Lines that a task compares at a time, and pairs of theirs that wait: the more, the fewer calls.
VERIFIED_LINES, VERIFIED_PAIRS = 1 << 14, 1 << 15
#: Edits for which distances of many pairs are counted in bytes, and in two bytes.
BYTE_EDITS, WORD_EDITS = 120, 4000
#: Widths of bands for each doubling.
BANDS = 1


def replaced(a: str, b: str, most: int) -> bool:
    """Whether one way from a to b takes at most ``most`` edits: by replacing, dropping and adding words wherever, from left to
    right, the words differ until the next ones that don't.  If it takes more, there may be a shorter way."""
    v, w = a.split(" "), b.split(" ")
    n, m = len(v), len(w)
    i = j = held = 0
    gaps = []
    while i < n or j < m:
        if i < n and j < m and v[i] == w[j]:
            i, j = i + 1, j + 1
            continue
        p, q = _next_alike(v, w, i, j)
        # Every word has a space behind it; if words meet words, one such space meets another.
        x, y = " ".join(v[i : i + p]), " ".join(w[j : j + q])
        gaps.append((x, y))
        held += max(len(x), len(y)) + (not p or not q)
        if held > 1.2 * most:
            return False
        i, j = i + p, j + q
    if held <= most:
        return True
    return sum(edit_distance(x, y, most) if x and y else len(x) + len(y) + 1 for x, y in gaps) <= most


def _next_alike(v: list[str], w: list[str], i: int, j: int) -> tuple[int, int]:
    """How many words of v from i and of w from j are passed, few in all, until two (or the last ones) are alike."""
    n, m = len(v) - i, len(w) - j
    for s in range(1, min(n + m, NEXT_WORDS)):
        for p in range(max(0, s - m + 1), min(s + 1, n)):
            x, y = i + p, j + s - p
            if v[x] == w[y] and v[x + 1 : x + 2] == w[y + 1 : y + 2]:
                return p, s - p
    return n, m


#: Words passed at a time at most where two lines differ, before all that is left is taken to differ.
NEXT_WORDS = 9


def distances(a: list[str], b: list[str], most: int, limits: np.ndarray | None = None) -> np.ndarray:
    """Levenshtein distances of pairs as far as they are at most ``most`` (up to WORD_EDITS); what is larger is over it.

    All pairs go through one band of diagonals at once, one antidiagonal after another: diagonals of one parity are
    derived from the other's.  A way of few edits leaves the diagonals between its ends by half of what is to spare, so
    the band has ``most`` + 1 of them.  Pairs that are done go, and those that are over their own ``limits`` (at most ``most``).
    """
    n, most = len(a), max(1, most)
    limits = np.full(n, most) if limits is None else limits
    kind, none = (np.uint8, BYTE_EDITS + 10) if most <= BYTE_EDITS else (np.uint16, WORD_EDITS + 10)
    ends = np.array([(len(x), len(y)) for x, y in zip(a, b)])
    longest = int(ends.max()) + 2
    apart = ends[:, 1] - ends[:, 0]
    inside = apart[np.abs(apart) <= most]
    if not len(inside):
        return np.full(n, none, np.int64)
    # Diagonals -low, ..., high (of b's places less a's): an odd number of them.
    low, high = int((most - inside.min()) // 2), int((most + inside.max()) // 2)
    high += (low + high) % 2
    half = (low + high) // 2
    edge = max(low, high) + 2

    def laid(texts: list[str], filler: int) -> np.ndarray:
        # A column a text, with a filler that the other side doesn't have.
        out = np.full((n, longest + 2 * edge), filler, np.uint32)
        for row, t in zip(out, texts):
            row[edge : edge + len(t)] = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32)
        if int(out[:, edge:-edge].max(initial=0)) < 1 << 16 or (out[out < 1 << 21] < 65_000).all():
            out = np.where(out >= 1 << 21, 65_000 + (out & 1), out).astype(np.uint16)
        return np.ascontiguousarray(out.T)

    x, y = laid(a, 1 << 30)[::-1], laid(b, 1 << 30 | 1)
    if x.dtype != y.dtype:
        x, y = x.astype(np.uint32), y.astype(np.uint32)
    x = np.ascontiguousarray(x)
    # Diagonals -low, -low + 2, ... and those between, with a margin that is never reached.
    own = np.full((half + 1, n), none, kind)
    other = np.full((half + 2, n), none, kind)
    if low % 2 == 0:
        own[low // 2] = 0
    else:
        other[low // 2 + 1] = 0
    left = {}
    for i, (p, q) in enumerate(ends.tolist()):
        left.setdefault(p + q, []).append((i, q - p + low))
    out = np.full(n, none, np.int64)
    for i, place in left.get(0, []):
        out[i] = 0
    total, column, alive = ends.sum(1), np.arange(n), np.arange(n)
    for t in range(1, int(total.max()) + 1):
        first = (t + low) % 2  # place of the first diagonal of this parity
        count = half + 1 - first
        # There, a[i - 1] meets b[j - 1]; further on i falls and j rises.
        i, j = (t + low - first) // 2, (t - low + first) // 2
        p, q = x.shape[0] - edge - i, edge + j - 1
        differ = x[p : p + count] != y[q : q + count]
        if first == 0:
            now, one, two = own, other[:-1], other[1:]
        else:
            now, one, two = other[1:-1], own[:-1], own[1:]
        step = np.minimum(one, two)
        step += 1
        now += differ.view(np.uint8)
        np.minimum(now, step, out=now)
        for k, place in left.get(t, ()):
            if column[k] >= 0 and 0 <= place <= low + high and place % 2 == first:
                out[k] = now[place // 2, column[k]]
        if t % 32 == 0:
            # What can't be reached grows by one a step.
            np.minimum(own, none, out=own)
            np.minimum(other, none, out=other)
            stay = (total[alive] > t) & (np.minimum(own.min(0), other.min(0)) <= limits[alive])
            if stay.sum() <= 0.7 * len(alive):
                alive = alive[stay]
                if not len(alive):
                    break
                column[:] = -1
                column[alive] = np.arange(len(alive))
                x, y, own, other = (np.ascontiguousarray(z[:, stay]) for z in (x, y, own, other))
    return out


def edits(size: np.ndarray, similarity: float) -> np.ndarray:
    """Most edits between lines, the longer of which has ``size`` characters."""
    return ((1 - similarity) * size + 1e-9).astype(np.int64)


def half_marks(line: bytes, size: int) -> list[int]:
    """Marks of a line of which one edit is allowed: its first and last bytes, as many as half the shorter line of a pair
    has at least; one pair of marks if the longer line has ``size`` characters, one if it has one more."""
    out = []
    for longer in (size, size + 1):
        n = (longer - 1) // 2
        for end, part in enumerate((line[:n], line[-n:])):
            digest = hashlib.md5(part + bytes([longer, end]), usedforsecurity=False).digest()
            out.append(max(1, int.from_bytes(digest[:4], "little")))
    return out


def line_posts(data: np.ndarray, eight: np.ndarray, starts: np.ndarray, sizes: np.ndarray, chars: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of lines, their posts (where lines meet others of that similarity), and the sketch of marks beside each post."""
    rows, posts, drawn = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    short = int(2 / (1 - similarity) + 1e-9)  # two edits from this size on
    marked = ((chars >= int(similarity * SHORT_CHARS), LONG_RUN), ((chars >= int(similarity * short)) & (chars < SHORT_CHARS), SHORT_RUN))
    for k, (chosen, width) in enumerate(marked):
        at = np.flatnonzero(chosen & (sizes >= width))
        if len(at):
            made = marks(*runs_of_bytes(eight, starts[at], sizes[at], width), ORDERS)
            rows.append(np.repeat(at, ORDERS))
            posts.append(posts_of(made, chars[at], k * ORDERS).reshape(-1))
            drawn.append(np.repeat(sketches(made), ORDERS))
    at = np.flatnonzero(edits(chars, similarity) == 1)
    if len(at):
        raw = data.tobytes()
        made = np.array([half_marks(raw[starts[i] : starts[i] + sizes[i]], int(chars[i])) for i in at], np.uint64)
        both = [posts_of(made[:, k : k + 2], chars[at], COLUMNS) for k in (0, 2)]
        rows.append(np.repeat(at, 4))
        posts.append(np.hstack(both).reshape(-1))
        drawn.append(np.zeros(4 * len(at), np.int64))
    return np.concatenate(rows), np.concatenate(posts), np.concatenate(drawn)


def lines_of(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, line, key, lead, norm, new of each line that has a word, and for each document a row with line
    -1 and its number of lines in ``n_lines``.  ``new`` is where a task meets a line first; ``lead`` stands for the row."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()

        def lines(ids: pa.Array, keys: pa.Array, texts: list[str], numbers: list[int]) -> pa.RecordBatch:
            data, sizes, counts = normal_lines(texts)
            doc = np.repeat(numbers, counts)
            line = np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts, counts)
            some = sizes > 0
            doc, line, sizes = doc[some], line[some], sizes[some]
            ends = np.r_[0, np.cumsum(sizes)]
            raw = data.tobytes()
            digests = [hashlib.md5(raw[s:e], usedforsecurity=False).digest() for s, e in zip(ends.tolist(), ends[1:].tolist())]
            if len(seen) > SEEN_LINES:
                seen.clear()
            new = []
            for d in digests:
                new.append(d not in seen)
                seen.add(d)
            of = pa.array(doc, pa.int32())
            norm = pa.StringArray.from_buffers(len(doc), pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(raw))
            columns = [ids.take(of), keys.take(of), pa.array(line, pa.int32()), pa.array(digests, pa.binary()), norm, pa.array(new, pa.bool_()), pa.nulls(len(doc), pa.int64())]
            return pa.RecordBatch.from_arrays(columns, names=_NAMES)

        for batch in batches:
            ids, keys, texts = batch.column("doc_id"), batch.column("text_key"), batch.column("text").to_pylist()
            part, held = [], 0
            for d, t in enumerate(texts):
                if t:
                    part.append(d)
                    held += len(t)
                if part and (held > PART_BYTES or d == len(texts) - 1):
                    yield lines(ids, keys, [texts[i] for i in part], part)
                    part, held = [], 0
            n = len(texts)
            counts = pa.array([t.count("\n") + 1 if t else 0 for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([ids, keys, pa.array([-1] * n, pa.int32()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.string()), pa.nulls(n, pa.bool_()), counts], names=_NAMES)

    kind = docs.schema["doc_id"].dataType.simpleString()
    slim = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key"), "text")
    made = slim.mapInArrow(split, f"doc_id {kind}, text_key long, line int, key binary, norm string, new boolean, n_lines long")
    return made.withColumn("lead", F.xxhash64("doc_id", "text_key", "line"))


_NAMES = ["doc_id", "text_key", "line", "key", "norm", "new", "n_lines"]


def posts_by_line(lines: DataFrame, similarity: float) -> DataFrame:
    """id, fp, sketch, post: where each of ``lines`` (id, norm) meets others; none for lines of which no edit is allowed."""

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            norm = batch.column("norm")
            if not len(norm):
                continue
            offsets = norm.offsets.to_numpy() if hasattr(norm, "offsets") else np.frombuffer(norm.buffers()[1], np.int32)[norm.offset : norm.offset + len(norm) + 1]
            whole = np.frombuffer(norm.buffers()[2], np.uint8)
            ids = batch.column("id").to_numpy()
            at = 0
            while at < len(ids):
                end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + PART_BYTES)) - 1)
                ends = (offsets[at : end + 1] - offsets[at]).astype(np.int64)
                data = whole[offsets[at] : offsets[end]]
                chars = np.diff(ends) if data.max(initial=0) < 128 else np.diff(np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[ends])
                chosen = np.flatnonzero(edits(chars, similarity) > 0)
                if len(chosen):
                    starts, sizes, own = ends[:-1][chosen], np.diff(ends)[chosen], ids[at:end][chosen]
                    padded = np.concatenate([data, np.zeros(16, np.uint8)])
                    eight = np.ndarray((len(padded) - 8,), np.uint64, padded, 0, (1,)).copy()
                    fp = simhashes(*runs_of_bytes(eight, starts, sizes, 4)).view(np.int64)
                    row, posts, sketch = line_posts(data, eight, starts, sizes, chars[chosen], similarity)
                    yield pa.RecordBatch.from_arrays([pa.array(own[row]), pa.array(fp[row]), pa.array(sketch), pa.array(posts)], names=["id", "fp", "sketch", "post"])
                at = end

    return lines.mapInArrow(post, "id long, fp long, sketch long, post long")


def may_hold(rows: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """Those of ``rows`` whose ``key`` may be among ``wanted`` (column ``_key``), and few others.

    The filter is a bitmap of 2**FILTER_BITS bits, sent as at most 2**(FILTER_BITS - 6)
    rows of 64 bits however many keys there are; more keys only let more rows pass.
    """
    place = lambda c: F.pmod(F.xxhash64(c, F.lit(5)), F.lit(1 << FILTER_BITS))
    word, bit = lambda c: F.shiftright(place(c), 6), lambda c: place(c).bitwiseAND(F.lit(63)).cast("int")
    spots = wanted.select(word("_key").alias("_word"), F.call_function("shiftleft", F.lit(1).cast("long"), bit("_key")).alias("_bit"))
    words = spots.groupBy("_word").agg(F.bit_or("_bit").alias("_bits"))
    on = word(key) == F.col("_word")
    hit = F.call_function("shiftrightunsigned", F.col("_bits"), bit(key)).bitwiseAND(F.lit(1)) == 1
    return rows.join(F.broadcast(words), on).where(hit).drop("_word", "_bits")


def edit_tests(similarity: float) -> Callable:
    """Tests of a part's pairs of lines, as ``verified_links`` wants them."""

    def prepare(bodies: np.ndarray, sizes: np.ndarray) -> tuple[Callable, Callable]:
        counts: list[np.ndarray] = []

        def threes() -> np.ndarray:
            # How often runs of three characters, in GRAM_CLASSES classes, occur in each line.
            out = np.empty((len(bodies), GRAM_CLASSES), np.int16)
            for s in range(0, len(bodies), 128):
                some = bodies[s : s + 128]
                code = np.frombuffer("".join(some).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
                row = np.repeat(np.arange(len(some)), [len(x) for x in some])
                run = mixed(code[:-2] << np.uint64(42) | code[1:-1] << np.uint64(21) | code[2:]) % np.uint64(GRAM_CLASSES)
                inside = row[:-2] == row[2:]
                flat = np.bincount(row[:-2][inside] * GRAM_CLASSES + run[inside].astype(np.int64), minlength=len(some) * GRAM_CLASSES)
                out[s : s + 128] = np.minimum(flat, 16_000).reshape(-1, GRAM_CLASSES)
            return out

        def may(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            # An edit makes and removes three runs at most, so similar lines differ by six times the edits.
            if not counts:
                counts.append(threes())
            out = np.empty(len(a), bool)
            for s in range(0, len(a), 512):
                u, v = a[s : s + 512], b[s : s + 512]
                apart = np.abs(counts[0][u] - counts[0][v]).sum(1, dtype=np.int64)
                out[s : s + 512] = apart <= 6 * edits(np.maximum(sizes[u], sizes[v]), similarity)
            return out

        def alike(u: np.ndarray, v: np.ndarray) -> np.ndarray:
            most = edits(np.maximum(sizes[u], sizes[v]), similarity)
            out = np.zeros(len(u), bool)
            pairs = [_trimmed(*sorted((bodies[i], bodies[j]), key=len)) for i, j in zip(u.tolist(), v.tolist())]
            length = np.array([len(y) for _, y in pairs])
            out[length <= most] = True
            order = np.flatnonzero(~out & (np.abs(sizes[u] - sizes[v]) <= most))
            # Lines of which words were replaced need no table of distances.
            out[order] = [replaced(*pairs[k], int(most[k])) for k in order.tolist()]
            order = order[~out[order]]
            # Few calls: a step of one costs as much for a hundred pairs as for ten.
            band = (BANDS * np.log2(most + 24)).astype(np.int64)
            order = order[np.lexsort((length[order], band[order]))]
            at = 0
            while at < len(order):
                # Pairs of about one band at a time: it is as wide as that of the widest of them.
                some = order[at : at + min(int((band[order[at:]] == band[order[at]]).sum()), 1024)]
                at += len(some)
                widest = int(most[some].max())
                if len(some) >= 6 and widest <= WORD_EDITS:
                    out[some] = distances([pairs[k][0] for k in some], [pairs[k][1] for k in some], widest, most[some]) <= most[some]
                else:
                    out[some] = [edit_distance(*pairs[k], int(most[k])) <= most[k] for k in some]
            return out

        return may, alike

    return prepare


def line_links(lines: DataFrame, classes: DataFrame, similarity: float) -> DataFrame:
    """Edges (a, b) between the keys of lines that meet and whose texts are similar enough; a forest of them per unit."""
    posted = posts_by_line(lines.where("new").select(id_of("key").alias("id"), "norm"), similarity)
    units = met_units(posted, REACH, similarity)
    # Lines that meet no other need no text.
    met = units.select(F.col("id").alias("_id")).distinct()
    wanted = classes.withColumn("id", id_of("key")).join(met, F.col("id") == F.col("_id")).select(F.col("id"), F.col("lead").alias("_key"))
    wanted = write_table(wanted, "wanted")
    one = may_hold(lines.where("new").select("key", "lead", "norm"), "lead", wanted).join(wanted, F.col("lead") == F.col("_key"))
    # Rows of another line that have the same lead by chance are none of that id's.
    one = one.where(id_of("key") == F.col("id")).select("id", "key", F.col("norm").alias("body"))
    return verified_links(units, one, edit_tests(similarity), REACH, similarity, part_rows=VERIFIED_LINES, pairs=VERIFIED_PAIRS)


def removed_lines(docs: DataFrame, similarity: float = 0.9) -> tuple[DataFrame, DataFrame]:
    """Of the documents that lose lines: doc_id, text_key, removed (line numbers from 0, sorted); and doc_id,
    text_key, n_lines of each document; see ``dedup_lines``."""
    if not 0.8 <= similarity < 1:
        raise ValueError("similarity must be from 0.8 to below 1")
    # Lines, keys and leads seldom repeat in a task: a dictionary of them is made in vain.
    written = write_table(lines_of(docs), "lines", **{f"parquet.enable.dictionary#{c}": "false" for c in ("key", "norm", "lead")})
    lines = written.where("line >= 0")
    # A line's text is read where it was posted: of those places the least.
    lead = F.min(F.when(F.col("new"), F.col("lead"))).alias("lead")
    classes = write_table(lines.groupBy("key").agg(lead, F.count(F.lit(1)).alias("n")), "line-classes")
    reached = connected_components(line_links(lines, classes, similarity))
    joined = classes.join(reached, classes["key"] == reached["node"], "left").where("component IS NOT NULL OR n > 1")
    # Lines that are alone stay; of the others the group's first occurrence does.
    repeated = joined.select(F.col("key").alias("_key"), F.coalesce("component", "key").alias("group"))
    slim = lines.select("doc_id", "text_key", "line", "key")
    found = write_table(slim.join(repeated, slim["key"] == repeated["_key"]).select("doc_id", "text_key", "line", "group"), "occurrences")
    keepers = found.groupBy(F.col("group").alias("_group")).agg(F.min(F.struct("doc_id", "text_key", "line")).alias("keep"))
    kept_here = (F.col("line") == F.col("keep.line")) & (F.col("text_key") == F.col("keep.text_key")) & F.col("doc_id").eqNullSafe(F.col("keep.doc_id"))
    gone = found.join(keepers, found["group"] == keepers["_group"]).where(~kept_here)
    # A document's own lines meet in one task, as they do in its text.
    removed = write_table(gone.groupBy("doc_id", "text_key").agg(F.sort_array(F.collect_set("line")).alias("removed")), "removed")
    return removed, written.where("line = -1").select("doc_id", "text_key", "n_lines")


def line_report(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_lines, n_removed, removed_lines of each row of ``docs``; see ``dedup_lines`` for the rules and ``options``."""
    gone, slim = removed_lines(docs, **options)
    gone = gone.select(F.col("doc_id").alias("_doc"), F.col("text_key").alias("_text"), "removed")
    on = slim["doc_id"].eqNullSafe(gone["_doc"]) & (slim["text_key"] == gone["_text"])
    removed = F.coalesce("removed", F.array().cast("array<int>"))
    return slim.join(gone, on, "left").select("doc_id", "n_lines", F.size(removed).cast("long").alias("n_removed"), removed.alias("removed_lines"))


def dedup_lines(docs: DataFrame, **options) -> DataFrame:
    """``docs`` (doc_id, text and any other columns) without the lines that repeat others.

    Lines are compared in lower case by their words, which ASCII characters other than
    letters and digits end; lines without a word are left alone.  Two different lines
    are linked if they are candidates (see the module) and 1 - edit distance / longer
    length is at least ``similarity`` (0.9).  Of all lines that links or equality join, of
    whatever length, the occurrence with the smallest (doc_id, hash of the text, line
    number) stays; a null doc_id is the smallest.  A document that loses all its lines
    goes; a null or empty text is left as it is.  Rows that repeat doc_id and text lose
    the same lines, so one line of theirs stays in each of them.  An empty table gives an
    empty one.  Columns may have any names.
    """
    gone = removed_lines(docs, **options)[0].select(F.col("doc_id").alias("_doc"), F.col("text_key").alias("_text"), "removed")
    # Whatever the columns are called, they travel in one.
    packed = docs.select(F.struct("*").alias("row"), "doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("key"))
    joined = packed.join(gone, packed["doc_id"].eqNullSafe(gone["_doc"]) & (packed["key"] == gone["_text"]), "left")
    left = F.filter(F.split("text", "\n", -1), lambda x, i: ~F.array_contains("removed", i))
    kept = joined.withColumn("left", F.when(F.col("removed").isNotNull(), left)).where("removed IS NULL OR size(left) > 0")
    text = F.when(F.col("removed").isNull(), F.col("text")).otherwise(F.array_join("left", "\n"))
    return kept.select(*[text.alias(c) if c == "text" else F.col("row")[c].alias(c) for c in docs.columns])
