"""Token counts by a compiled finite-state tokenizer.

The tokenizer (word BPE with an end-of-word suffix) is compiled into a
deterministic transducer over bytes.  Its transitions carry the change in the
number of tokens of what has been read; states are built when first reached and
kept.  A state is what the future can depend on: for each token prefix that
could still be open, where it began, the token that ended there, and the
difference in tokens.

White space resets the whole machine (normaliser, word splitter, transducer), so
a chunk of text has a state map that is short to write down: the text before its
first white space (read from whatever state came in), the tokens of the rest,
and the text after its last white space (the state it leaves).  Maps of
neighbouring chunks compose, which is associative, so the chunks of one text are
counted in parallel and joined by a prefix scan.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters whose class and lower case are the same in every Unicode version in use; others are asked of the library.
_PLAIN = re.compile("[\t\n\r\x20-\x7e¡-¬®-įı-ž]*")
_SPACE = re.compile("[ \t\n\r]")
_MAX_STATES, _MAX_WORDS = 200_000, 300_000


class Transducer:
    """Counts the BPE tokens of words (bytes), one transition for each byte."""

    def __init__(self, tokenizer_json: dict):
        model = tokenizer_json["model"]
        self._suffix = model["end_of_word_suffix"] or ""
        chars = byte_chars()
        code = {c: b for b, c in chars.items()}
        # Symbols 0-255 are bytes, 256-511 bytes that end a word.
        self._rank: dict[tuple, tuple[int, tuple]] = {}
        tokens = set()
        for token in model["vocab"]:
            if (s := self._symbols(token, code)) is not None:
                tokens.add(s)
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            a, b = self._symbols(a, code), self._symbols(b, code)
            self._rank[a, b] = (rank, a + b)
        # Trie over the tokens that their own symbols merge into.
        self._next: dict[int, int] = {}
        self._token_at: dict[int, tuple] = {}
        size = 1
        for t in sorted(tokens):
            if self.merge(t) != [t]:
                continue
            node = 0
            for s in t:
                if (to := self._next.get(node << 9 | s)) is None:
                    to = self._next[node << 9 | s] = size
                    size += 1
                node = to
            self._token_at[node] = t
        self._pairs: dict[tuple, bool] = {}
        self.words: dict[str, int] = {}
        self._forget()

    def _symbols(self, token: str, code: dict[str, int]) -> tuple | None:
        ends = bool(self._suffix) and token.endswith(self._suffix) and len(token) > len(self._suffix)
        body = token[: -len(self._suffix)] if ends else token
        if any(c not in code for c in body):
            return None  # a special token
        s = [code[c] for c in body]
        if ends:
            s[-1] += 256
        return tuple(s)

    def merge(self, symbols: tuple) -> list[tuple]:
        """The tokens of a symbol string by repeated merges, lowest rank first."""
        parts = [(s,) for s in symbols]
        while len(parts) > 1:
            best = min((self._rank.get((a, b), (1 << 60, ()))[0], i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if best[0] == 1 << 60:
                break
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
        return parts

    def _forget(self) -> None:
        start = ((0, None, 0),)
        self._states = [start]
        self._ids = {start: 0}
        self._step: dict[int, tuple[int, int]] = {}

    def _follows(self, before: tuple | None, token: tuple) -> bool:
        """Whether ``token`` stays a token of its own after ``before``."""
        if before is None:
            return True
        if (ok := self._pairs.get((before, token))) is None:
            if len(self._pairs) > _MAX_STATES:
                self._pairs.clear()
            ok = self._pairs[before, token] = self.merge(before + token) == [before, token]
        return ok

    def _build(self, state: int, symbol: int) -> tuple[int, int]:
        """Transition: for each open start (trie node, token that ended there, tokens there less tokens here)."""
        emitted, last = None, None
        opened = []
        for node, before, delta in self._states[state]:
            to = self._next.get(node << 9 | symbol)
            if to is None:
                continue
            opened.append((to, before, delta))
            token = self._token_at.get(to)
            if token is not None and emitted is None and self._follows(before, token):
                emitted, last = delta + 1, token  # the longest that holds: starts come in order
        if emitted is None:
            raise ValueError(f"no token ends at symbol {symbol}")
        key = (*[(n, b, d - emitted) for n, b, d in opened], (0, last, 0))
        if (to := self._ids.get(key)) is None:
            to = self._ids[key] = len(self._states)
            self._states.append(key)
        self._step[state << 9 | symbol] = found = (to, emitted)
        return found

    def count(self, word: bytes) -> int:
        """Tokens of one word; its last byte is read as the word's end."""
        if len(self._step) > 2 * _MAX_STATES or len(self._states) > _MAX_STATES:
            self._forget()
        state = total = 0
        step = self._step
        for s in word[:-1]:
            state, n = step.get(state << 9 | s) or self._build(state, s)
            total += n
        s = word[-1] + (256 if self._suffix else 0)
        return total + (step.get(state << 9 | s) or self._build(state, s))[1]


def byte_chars() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    kept = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    free = iter(range(256, 512))
    return {b: chr(b) if b in kept else chr(next(free)) for b in range(256)}


class CompiledTokenizer:
    """Counts tokens as the library does for a tokenizer file of this kind: normaliser, splitter, word BPE."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        kinds = [x["type"] for x in spec["normalizer"]["normalizers"]], [x["type"] for x in spec["pre_tokenizer"]["pretokenizers"]]
        if kinds != (["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"]) or spec["post_processor"]:
            raise ValueError(f"not a tokenizer that can be compiled: {kinds}")
        self._library = Tokenizer.from_file(path)
        self._library.no_truncation()
        self._transducer = Transducer(spec)
        import regex

        self._split = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        specials = [x["content"] for x in spec["added_tokens"]]
        self._special = re.compile("|".join(map(re.escape, specials))) if specials else None
        self._words: dict[str, int] = {}

    def words(self, text: str) -> list[str]:
        """The words of a text without special strings, after normalisation."""
        if _PLAIN.fullmatch(text):
            if not text.isascii():
                text = unicodedata.normalize("NFC", text)
            return self._split.findall(text.lower())
        normal = self._library.normalizer.normalize_str(text)
        # The second step of the splitter maps bytes to characters; the first alone gives the words' places.
        chars = {c: b for b, c in byte_chars().items()}
        pieces = self._library.pre_tokenizer.pre_tokenize_str(normal)
        return [bytes(chars[c] for c in p).decode("utf-8", "surrogateescape") for p, _ in pieces]

    def _count_words(self, words: list[str]) -> int:
        known, total = self._words, 0
        for w in words:
            n = known.get(w)
            if n is None:
                if len(known) >= _MAX_WORDS:
                    known.clear()
                n = known[w] = self._transducer.count(w.encode("utf-8", "surrogateescape"))
            total += n
        return total

    def count(self, text: str) -> int:
        if not text:
            return 0
        if self._special is None or "<|" not in text:
            return self._count_words(self.words(text))
        parts = self._special.split(text)
        return len(parts) - 1 + sum(self._count_words(self.words(p)) for p in parts if p)

    def state_map(self, chunk: str) -> tuple[str, int, str | None]:
        """(head, tokens between, tail): the chunk up to its first white space, and from its last; tail None if it has none."""
        first = _SPACE.search(chunk)
        if first is None:
            return chunk, 0, None
        last = max(chunk.rfind(c) for c in " \t\n\r")
        return chunk[: first.start()], self.count(chunk[first.start() : last + 1]), chunk[last + 1 :]

    def compose(self, a: tuple[str, int, str | None], b: tuple[str, int, str | None]) -> tuple[str, int, str | None]:
        """The state map of two neighbouring chunks from theirs."""
        if a[2] is None:
            return a[0] + b[0], b[1], b[2]
        if b[2] is None:
            return a[0], a[1], a[2] + b[0]
        return a[0], a[1] + self.count(a[2] + b[0]) + b[1], b[2]

    def scan(self, maps: list[tuple[str, int, str | None]]) -> list[tuple[str, int, str | None]]:
        """Inclusive prefix scan by doubling: after step k each map covers 2**k chunks; steps are independent of order."""
        maps, reach = list(maps), 1
        while reach < len(maps):
            maps = maps[:reach] + [self.compose(maps[i - reach], maps[i]) for i in range(reach, len(maps))]
            reach *= 2
        return maps

    def closed(self, whole: tuple[str, int, str | None]) -> int:
        """Tokens of a text from its state map: the map applied to the start state, and the state that it ends in closed."""
        head, n, tail = whole
        return self.count(head) + n + (self.count(tail) if tail else 0)


_COMPILED: dict[str, CompiledTokenizer] = {}


def compiled(path: str) -> CompiledTokenizer:
    """The tokenizer of a file, compiled once in a process."""
    if path not in _COMPILED:
        _COMPILED[path] = CompiledTokenizer(path)
    return _COMPILED[path]


def token_counts(docs: DataFrame, path: str, chunk_chars: int = 1 << 16, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > ``limit``) of each row of ``docs`` (doc_id, text).

    Texts of up to ``chunk_chars`` characters are counted where they are read.  Longer ones are
    cut into chunks that are rows of their own, so one long text is counted by many tasks;
    only their chunks' state maps are shuffled (a few bytes each, but for text without
    white space), and a prefix scan composes those of a text.  Null and empty texts have no
    tokens.  Repeated rows are counted one by one.  An empty table gives none.
    """
    text = F.coalesce(docs["text"], F.lit(""))
    rows = docs.select(docs["doc_id"].alias("doc_id"), text.alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    n_bytes = F.octet_length("text").cast("long").alias("n_bytes")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = compiled(path)
        for batch in batches:
            n = pa.array([machine.count(t) for t in batch.column("text").to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), n], names=["doc_id", "n_bytes", "n_tokens"])

    result = f"doc_id {kind}, n_bytes long, n_tokens long"
    short = rows.where(F.length("text") <= chunk_chars).select("doc_id", n_bytes, "text").mapInArrow(count, result)
    chunks = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{chunk_chars}}}"), F.lit(0))
    long = rows.where(F.length("text") > chunk_chars)
    pieces = long.select("doc_id", F.xxhash64("text").alias("text_key"), n_bytes, F.posexplode(chunks).alias("k", "chunk"))

    def annotate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = compiled(path)
        for batch in batches:
            found = [machine.state_map(chunk) for chunk in batch.column("chunk").to_pylist()]
            columns = [batch.column(c) for c in ("doc_id", "text_key", "n_bytes", "k")]
            kinds = (pa.string(), pa.int64(), pa.string())
            columns += [pa.array(c, t) for c, t in zip(zip(*found) if found else ((), (), ()), kinds)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_key", "n_bytes", "k", "head", "between", "tail"])

    maps = pieces.mapInArrow(annotate, f"doc_id {kind}, text_key long, n_bytes long, k int, head string, between long, tail string")
    # Rows that repeat a document have equal maps: one of each is composed, for as many rows as begin with a first chunk.
    joined = maps.groupBy("doc_id", "text_key", "n_bytes").agg(
        F.sort_array(F.collect_set(F.struct("k", "head", "between", "tail"))).alias("maps"), F.count(F.when(F.col("k") == 0, 1)).alias("copies")
    )

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = compiled(path)
        for batch in batches:
            of_texts = batch.column("maps").to_pylist()
            totals = [machine.closed(machine.scan([(m["head"], m["between"], m["tail"]) for m in ms])[-1]) for ms in of_texts]
            columns = [batch.column("doc_id"), batch.column("n_bytes"), pa.array(totals, pa.int64()), batch.column("copies")]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_bytes", "n_tokens", "copies"])

    scanned = joined.select("doc_id", "n_bytes", "maps", "copies").mapInArrow(close, f"{result}, copies long")
    whole = scanned.select("doc_id", "n_bytes", "n_tokens", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).drop("col")
    return short.union(whole).withColumn("over_limit", F.col("n_tokens") > limit)
