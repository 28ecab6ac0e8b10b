"""Secrets in texts, also below layers of encoding.

A text is the first layer of a worklist.  Each layer is searched, and each layer
that it unwraps to (URL escapes, Unicode escapes, base64, compressed bytes) joins
the list, until nothing new comes; a layer that was there before (same content,
same place) is not taken again, which ends cycles.  Characters of a layer know
the span of the text that they come from, so what is found is reported there.
"""

from __future__ import annotations

import binascii
import bz2
import hashlib
import lzma
import re
import zlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

KINDS = ("assign", "access", "hex")
# The patterns of the kinds.
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile("AKIA[A-Z0-9]+")
_HEX = re.compile("[0-9a-f]{24,}")
_NAMES = ("passw", "secret", "token", "apikey", "api_key")
_LEAST = {"value": 6, "access": 20}

_PERCENT = re.compile("(?:%[0-9A-Fa-f]{2})+")
_ESCAPE = re.compile(r"\\u[dD][89abAB][0-9a-fA-F]{2}\\u[dD][c-fC-F][0-9a-fA-F]{2}|\\u\{[0-9a-fA-F]{1,6}\}|[\\%]u[0-9a-fA-F]{4}|\\U[0-9a-fA-F]{8}|\\x[0-9a-fA-F]{2}|&#[0-9]{1,7};|&#[xX][0-9a-fA-F]{1,6};")
#: Shorter runs than 16 hold no secret of any kind.
_LONG = re.compile("[A-Za-z0-9+/_-]{16,}={0,2}")
_BASE64 = (re.compile("[A-Za-z0-9+/]{16,}={0,2}"), re.compile("[A-Za-z0-9_-]{16,}={0,2}"), re.compile("[A-Za-z0-9]{16,}={0,2}"))
_UNSEEN = re.compile("[\x00-\x08\x0e-\x1f\x7f]")
#: Bytes that one compressed layer may give; more is reported as unread, not searched.
LAYER_BYTES = 8 << 20

Places = tuple[list[int], list[int]]


class Layer(NamedTuple):
    """Text or bytes; ``places`` has start and end in the first layer for each character or byte (None: its own place)."""

    content: str | bytes
    places: Places | None

    def span(self, start: int, end: int) -> tuple[int, int]:
        """The span of the first layer that ``start`` to ``end`` of this one come from."""
        return (start, end) if self.places is None else (min(self.places[0][start:end]), max(self.places[1][start:end]))

    def spans(self, start: int, end: int) -> Places:
        """The places of each of ``start`` to ``end``."""
        return (list(range(start, end)), list(range(start + 1, end + 1))) if self.places is None else (self.places[0][start:end], self.places[1][start:end])


def find(text: str) -> Iterator[tuple[str, int, int]]:
    """Kind, start and end of the secrets written plainly in a text, leftmost and not overlapping for each kind."""
    lower = text.lower()
    if any(n in lower for n in _NAMES):
        for m in _ASSIGN.finditer(text):
            if m.end(2) - m.start(2) >= _LEAST["value"]:
                yield "assign", m.start(), m.end()
    if "AKIA" in text:
        for m in _ACCESS.finditer(text):
            if m.end() - m.start() >= _LEAST["access"]:
                yield "access", m.start(), m.end()
    for m in _HEX.finditer(text):
        yield "hex", m.start(), m.end()


def _replaced(layer: Layer, pattern: re.Pattern, decode: Callable[[str], list[tuple[str, int, int]] | None]) -> Layer | None:
    """The text with each match as the characters (and their places within the match) that ``decode`` gives."""
    text, at, changed = layer.content, 0, False
    parts: list[str] = []
    starts: list[int] = []
    ends: list[int] = []

    def keep(a: int, b: int) -> None:
        s, e = layer.spans(a, b)
        parts.append(text[a:b])
        starts.extend(s)
        ends.extend(e)

    for m in pattern.finditer(text):
        chars = decode(m.group())
        if chars is None:
            continue
        changed = True
        keep(at, m.start())
        for c, a, b in chars:
            s, e = layer.span(m.start() + a, m.start() + b)
            parts.append(c)
            starts.append(s)
            ends.append(e)
        at = m.end()
    if not changed:
        return None
    keep(at, len(text))
    return Layer("".join(parts), (starts, ends))


def _percent(run: str) -> list[tuple[str, int, int]] | None:
    try:
        text = bytes.fromhex(run.replace("%", "")).decode()
    except UnicodeDecodeError:
        return None
    out, at = [], 0
    for c in text:
        n = 3 * len(c.encode())
        out.append((c, at, at + n))
        at += n
    return out


def _escaped(run: str) -> list[tuple[str, int, int]] | None:
    if run[0] == "&":
        code = int(run[3:-1], 16) if run[2] in "xX" else int(run[2:-1])
    elif len(run) == 12:
        code = 0x10000 + ((int(run[2:6], 16) & 0x3FF) << 10) + (int(run[8:12], 16) & 0x3FF)
    else:
        code = int(run[2:].strip("{}"), 16)
    if code > 0x10FFFF or 0xD800 <= code < 0xE000:
        return None
    return [(chr(code), 0, len(run))]


def _from_base64(layer: Layer) -> Iterator[Layer]:
    """Each run of base64 characters as bytes, a byte with the place of the characters that hold its bits."""
    seen = set()
    for long in _LONG.finditer(layer.content):
        for pattern in _BASE64:
            for m in pattern.finditer(layer.content, long.start(), long.end()):
                if m.span() in seen:
                    continue
                seen.add(m.span())
                digits = m.group().rstrip("=").replace("-", "+").replace("_", "/")
                digits = digits[: len(digits) - (len(digits) % 4 == 1)]
                data = binascii.a2b_base64(digits + "=" * (-len(digits) % 4))
                if _opened(data) is None and _text(data) is None:
                    continue
                starts, ends = layer.spans(*m.span())
                yield Layer(data, ([starts[8 * i // 6] for i in range(len(data))], [ends[(8 * i + 7) // 6] for i in range(len(data))]))


def _percent_bytes(layer: Layer) -> Iterator[Layer]:
    """Runs of URL escapes that are no text, as bytes."""
    for m in _PERCENT.finditer(layer.content):
        data = bytes.fromhex(m.group().replace("%", ""))
        if _opened(data) is not None:
            starts, ends = layer.spans(*m.span())
            yield Layer(data, (starts[::3], ends[2::3]))


def _opened(data: bytes) -> Callable[[], object] | None:
    """What decompresses the bytes, by their first ones."""
    if data[:2] == b"\x1f\x8b":
        return lambda: zlib.decompressobj(31)
    if len(data) > 5 and data[0] & 15 == 8 and data[0] >> 4 <= 7 and (data[0] << 8 | data[1]) % 31 == 0:
        return zlib.decompressobj
    if data[:3] == b"BZh":
        return bz2.BZ2Decompressor
    if data[:6] == b"\xfd7zXZ\x00":
        return lambda: lzma.LZMADecompressor(memlimit=256 << 20)
    if data[:4] == b"\x28\xb5\x2f\xfd":
        return lambda: zstandard.ZstdDecompressor(max_window_size=1 << 27).decompressobj()
    return None


def _decompressed(data: bytes, most: int) -> tuple[bytes | None, bool]:
    """The bytes (None: not compressed after all) and whether there are more than ``most`` of them."""
    machine = _opened(data)()
    out: list[bytes] = []
    size = 0
    try:
        # Pieces of the input bound what comes at once.
        for at in range(0, len(data), 1024):
            out.append(machine.decompress(data[at : at + 1024]))
            size += len(out[-1])
            if size > most:
                return None, True
    except (zlib.error, OSError, EOFError, lzma.LZMAError, zstandard.ZstdError):
        pass  # what came before damage or trailing bytes is text all the same
    return (b"".join(out) or None), False


def _text(data: bytes) -> str | None:
    try:
        text = data.decode()
    except UnicodeDecodeError:
        return None
    return None if _UNSEEN.search(text) else text


def unwrap(layer: Layer, most: int = LAYER_BYTES) -> Iterator[Layer | None]:
    """The layers directly below one; None for one that is too large to read."""
    if isinstance(layer.content, bytes):
        if _opened(layer.content) is not None:
            data, unread = _decompressed(layer.content, most)
            if unread:
                yield None
            if data is not None:
                start, end = layer.span(0, len(layer.content))
                yield Layer(data, ([start] * len(data), [end] * len(data)))
        if (text := _text(layer.content)) is not None:
            starts, ends, at = [], [], 0
            for c in text:
                n = len(c.encode())
                starts.append(layer.places[0][at])
                ends.append(layer.places[1][at + n - 1])
                at += n
            yield Layer(text, (starts, ends))
        return
    text = layer.content
    if "%" in text:
        if (found := _replaced(layer, _PERCENT, _percent)) is not None:
            yield found
        yield from _percent_bytes(layer)
    if ("\\" in text or "&#" in text or "%u" in text) and (found := _replaced(layer, _ESCAPE, _escaped)) is not None:
        yield found
    yield from _from_base64(layer)


def scan(text: str | None, below: Callable[[Layer], Iterator[Layer | None]] = unwrap) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]], int]:
    """Secrets written plainly, all secrets with those of decoded layers (both by start, then kind, then end), and
    how many layers were too large to read.  A null text has none."""
    first = Layer(text or "", None)
    base = list(find(first.content))
    found, unread = set(base), 0
    waiting, seen = [first], set()
    while waiting:
        layer = waiting.pop()
        for child in below(layer):
            if child is None:
                unread += 1
                continue
            if not child.content:
                continue
            raw = child.content if isinstance(child.content, bytes) else child.content.encode("utf-8", "surrogatepass")
            # Content that came before from the same place leads nowhere new, however it was reached.
            mark = (type(child.content), hashlib.blake2b(raw, digest_size=16).digest(), child.places[0][0], child.places[1][-1])
            if mark in seen:
                continue
            seen.add(mark)
            waiting.append(child)
            if isinstance(child.content, str):
                found |= {(kind, *child.span(s, e)) for kind, s, e in find(child.content)}
    order = lambda x: (x[1], KINDS.index(x[0]), x[2])
    return sorted(base, key=order), sorted(found, key=order), unread


def written(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


def scan_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_decoded, n_unread of each row of ``docs`` (doc_id, text).

    The three counts and the digest are of what is written plainly; ``spans`` has what decoding adds too, in code
    points of the text; ``n_decoded`` counts the additions and ``n_unread`` compressed layers of more than
    ``LAYER_BYTES``.  Each row is read by itself and whole; null and empty texts have no secrets, repeated rows
    are kept.
    """

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column("text").to_pylist():
                base, found, unread = scan(text)
                count = [sum(k == kind for k, *_ in base) for kind in KINDS]
                rows.append((*count, hashlib.sha256(written(base).encode()).hexdigest(), written(found), len(found) - len(base), unread))
            kinds = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()] * 2
            columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_decoded", "n_unread"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(search, f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_decoded long, n_unread long")
