"""Phrases whose words come together more often than chance, for each language.

Counts of word sequences are wanted exactly, but only of those that come often.
A sketch finds them: a cell is the hash of a sequence, so its count is never below
that of a sequence in it.  Levels are swept from two words up, and a sequence is
put in the sketch only if both its parts, one word shorter, reached the count
there.  What reaches it is a candidate.  Candidates compile into automata whose
first letter of each word guards its border; they find all occurrences, overlapping
ones too; tasks count what their texts hold, and only exact sums decide.

Texts are read once: parts of text become numbers of words, and a word is a hash that
no other word of the table has, so automata of many phrases are small and scans cheap.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from itertools import count as numbers
from itertools import repeat

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.workspace import discard, set_for, write_table
from ..operators.ranking import number_within
from ..operators.splits import summed

LONGEST = 5
#: The sketch has 2**40 cells: those that some sequence falls in are counted.
_CELLS = np.uint64((1 << 40) - 1)
#: A filter of cells has 2**FILTER_BITS bits; more cells only let more candidates pass, which exact counts then reject.
FILTER_BITS = 24
#: Texts of a language that a task works on at a time, texts of all languages that it holds, room that a language takes besides
#: them, and phrases of one automaton (as hashes of words), in bytes.
PART_BYTES, HELD_BYTES, LANG_BYTES, AUTOMATON_BYTES = 1 << 20, 8 << 20, 256, 32 << 20
#: Cells and words that a task counts at a time, candidates that it names at a time, and rows of texts and of parts that Python
#: gets at a time.
HELD_CELLS, HELD_WORDS, HELD_NAMES, TEXT_ROWS, PART_ROWS = 1 << 20, 1 << 18, 1 << 16, 256, 8
#: Phrases whose counts are one array.
BLOCK = 1 << 12
#: The first hash of words that is tried; the next one is, if two words have the same.
FIRST_SALT = 0
#: Of its candidates a part of text names one in so many at first.
THIN = 32
_ROWS, _READ = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.parquet.columnarReaderBatchSize"
#: Hashes of the words of a phrase, 0 behind the last one.
_KEY = [f"c{i + 1}" for i in range(LONGEST)]
#: Stands between pieces of text as a word of its own; it breaks pieces, so no word has it.
_BREAK = b"."
_TABLE = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t,;:!?\n\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz " + _BREAK * 9)


def normal(text: str | None) -> bytes:
    """A text with A-Z lower-cased, one space between words, and a lone full stop wherever a piece ends."""
    return b" ".join(text.encode().translate(_TABLE).replace(_BREAK, b" . ").split()) if text else b""


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes]]:
    """lang and up to ``PART_BYTES`` of a task's normal text, a full stop behind each text; a longer text is a part alone.

    Batches are small, so a part takes texts of several: words that come often are counted, hashed and named once a part.
    All languages together hold ``HELD_BYTES`` at most, and a text.
    """
    held: dict[str, list[bytes]] = {}
    sizes: dict[str, int] = {}
    total = 0

    def part(lang: str) -> tuple[str, bytes]:
        nonlocal total
        total -= sizes.pop(lang)
        return lang, b" . ".join([*held.pop(lang), b""]).strip(b" ")

    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text")):
            body = normal(text.as_py())
            if not body.strip(b" ."):
                continue
            if lang in held and sizes[lang] + len(body) > PART_BYTES:
                yield part(lang)
            if total + len(body) > HELD_BYTES:
                yield from map(part, list(held))
            held.setdefault(lang, []).append(body)
            # A language itself takes room, so that many of them end too.
            size = len(body) + (0 if lang in sizes else LANG_BYTES)
            sizes[lang] = sizes.get(lang, 0) + size
            total += size
    yield from map(part, list(held))


def _words(body: bytes) -> pa.Array:
    """The words of a part of normal text, dictionary-encoded."""
    words = pc.split_pattern(pa.array([body.decode()], pa.large_string()), " ").flatten()
    return words.filter(pc.not_equal(words, "")).dictionary_encode()


def _cells(lang: str, words: pa.Array, salt: int = 0) -> np.ndarray:
    """The hash of each word of a part's dictionary, 0 for the break alone."""
    seed = xxhash.xxh64_intdigest(lang.encode(), 42)
    spelt = words.dictionary.cast(pa.large_binary()).to_numpy(zero_copy_only=False)
    cells = np.frombuffer(b"".join(map(xxhash.xxh64_digest, spelt, repeat(seed))), ">u8").astype(np.uint64)
    if salt:
        cells = np.array([xxhash.xxh64_intdigest(str(salt).encode(), c) for c in cells.tolist()], np.uint64)
    cells = np.maximum(cells, np.uint64(1))
    stop = pc.index(words.dictionary, _BREAK.decode()).as_py()
    if stop >= 0:
        cells[stop] = 0
    return cells


def coded(texts: DataFrame, salt: int) -> DataFrame:
    """Parts of ``texts`` (lang, text): lang, and as bytes the different words, a space between them, their cells, and which of
    them comes at each place (16 bits, if these are enough)."""

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, body in _parts(batches):
            words = _words(body)
            said = " ".join(words.dictionary.to_pylist()).encode()
            at = words.indices.to_numpy().astype(np.uint16 if len(words.dictionary) <= 1 << 16 else np.int32)
            yield pa.RecordBatch.from_arrays([pa.array([lang]), *(pa.array([x], pa.binary()) for x in (said, _cells(lang, words, salt).tobytes(), at.tobytes()))], names=["lang", "words", "cells", "at"])

    return texts.mapInArrow(code, "lang string, words binary, cells binary, at binary")


def _coded_words(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The cells of the different words of each part, and which of them comes at each place."""
    for batch in batches:
        for cells, at in zip(batch.column("cells"), batch.column("at")):
            known = np.frombuffer(cells.as_buffer(), np.uint64)
            yield known, np.frombuffer(at.as_buffer(), np.uint16 if len(known) <= 1 << 16 else np.int32)


def word_counts(parts: DataFrame) -> DataFrame:
    """lang, word, cell, n of ``parts`` of text."""

    def counted(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held).group_by(["lang", "word", "cell"], use_threads=False).aggregate([("n", "sum")])
        return table.select(["lang", "word", "cell", "n_sum"]).rename_columns(["lang", "word", "cell", "n"]).combine_chunks().to_batches()[0]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            for lang, words, (cells, at) in zip(batch.column("lang").to_pylist(), batch.column("words"), _coded_words([batch])):
                said = pc.split_pattern(pa.array([words.as_py().decode()], pa.large_string()), " ").flatten().cast(pa.string())
                columns = [pa.repeat(pa.scalar(lang), len(said)), said, pa.array(cells.view(np.int64)), pa.array(np.bincount(at, minlength=len(cells)), pa.int64())]
                held.append(pa.RecordBatch.from_arrays(columns, names=["lang", "word", "cell", "n"]))
                if sum(b.num_rows for b in held) > HELD_WORDS:
                    yield counted(held)
                    held = []
        if held:
            yield counted(held)

    counts = parts.select("lang", "words", "cells", "at").mapInArrow(count, "lang string, word string, cell long, n long")
    return counts.where("cell <> 0").groupBy("lang", "word", "cell").agg(F.sum("n").alias("n"))


# -- The sketch -----------------------------------------------------------------


def cell_filter(cells: DataFrame) -> np.ndarray:
    """A bitmap of ``cell`` (long), as words of 64 bits; at most 2**(FILTER_BITS - 6) rows come to the driver."""
    place = F.col("cell").bitwiseAND(F.lit((1 << FILTER_BITS) - 1))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(F.lit(63)).cast("int"))
    found = cells.select(F.shiftright(place, 6).alias("at"), bit.alias("bit")).groupBy("at").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    out[found.column("at").to_numpy()] = found.column("bits").to_numpy()
    return out.view(np.uint64)


def _holds(bitmap: np.ndarray, cells: np.ndarray) -> np.ndarray:
    place = cells & np.uint64(64 * len(bitmap) - 1)
    return (bitmap[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63)) & np.uint64(1)).astype(bool)


def _often(cells: np.ndarray, at: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """The cell of each word of a part, 0 for breaks and for words that are too rare."""
    return np.where(_holds(frequent, cells), cells, np.uint64(0))[at]


def _word_cells(lang: str, words: pa.Array, frequent: np.ndarray) -> np.ndarray:
    """``_often`` of the words of a part of normal text."""
    return _often(_cells(lang, words), words.indices.to_numpy(), frequent)


def _sequences(batches: Iterator[pa.RecordBatch], frequent: np.ndarray) -> Iterator[np.ndarray]:
    """The cells of the words of each part, rare words in a row being one break."""
    for cells, at in _coded_words(batches):
        ids = _often(cells, at, frequent)
        yield ids[(ids != 0) | np.r_[True, ids[:-1] != 0]]


def _levels(ids: np.ndarray, filters: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Level k from 2, the places where a sequence of k words starts whose parts of k - 1 words are in the filters
    (``filters[0]`` is that of two words), and the cells there.  One level more than there are filters."""
    cells, ok = ids, ids != 0
    for k in range(2, LONGEST + 1):
        with np.errstate(over="ignore"):
            x = cells[:-1] * np.uint64(0x9E3779B97F4A7C15) + ids[k - 1 :]
            x = (x ^ x >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
            cells = (x ^ x >> np.uint64(29)) & _CELLS
        ok = ok[:-1] & ok[1:]
        at = np.flatnonzero(ok)
        yield k, at, cells[at]
        if k - 2 >= len(filters):
            return
        ok = ok.copy()
        ok[at] = _holds(filters[k - 2], cells[at])


def level_cells(parts: DataFrame, frequent: Broadcast, filters: list[Broadcast], least: int) -> DataFrame:
    """``cell``, ``n``: cells of the level after those of ``filters`` whose count is ``least`` or more."""
    level = len(filters) + 2

    def counted(held: list[np.ndarray]) -> pa.RecordBatch:
        found, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n, pa.int64())], names=["cell", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = [f.value for f in filters]
        held: list[np.ndarray] = []
        for ids in _sequences(batches, frequent.value):
            held += [cells for k, _, cells in _levels(ids, known) if k == level]
            if sum(map(len, held)) > HELD_CELLS:
                yield counted(held)
                held = []
        if held:
            yield counted(held)

    counts = parts.select("cells", "at").mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    return counts.where(F.col("n") >= least)


def candidates(parts: DataFrame, frequent: Broadcast, filters: list[Broadcast], wanted: list[Broadcast], thin: int) -> DataFrame:
    """Words (``_KEY``), level, cell of sequences of 2 to ``LONGEST`` words whose cell is in ``wanted`` of its level, once each.

    A part of text names only one in ``thin`` of its cells, chosen by a hash of both: many parts would say the same names.
    """

    def named(held: list[np.ndarray]) -> pa.RecordBatch:
        table = pa.table([pa.array(c) for c in np.concatenate(held).T], names=[*_KEY, "level", "cell"])
        return table.group_by(table.column_names, use_threads=False).aggregate([]).combine_chunks().to_batches()[0]

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, names = [f.value for f in filters], [w.value for w in wanted]
        held: list[np.ndarray] = []
        for ids in _sequences(batches, frequent.value):
            turn = np.uint64(xxhash.xxh64_intdigest(ids.tobytes()))
            for k, at, cells in _levels(ids, known):
                with np.errstate(over="ignore"):
                    own = ((cells ^ turn) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)) % np.uint64(thin) == 0
                own &= _holds(names[k - 2], cells)
                at, cells = at[own], cells[own]
                for i in range(0, len(at), HELD_NAMES):
                    some = at[i : i + HELD_NAMES]
                    rows = np.zeros((len(some), LONGEST + 2), np.int64)
                    rows[:, :k] = ids[some[:, None] + np.arange(k)].view(np.int64)
                    rows[:, LONGEST], rows[:, LONGEST + 1] = k, cells[i : i + HELD_NAMES]
                    held.append(rows)
                    if sum(map(len, held)) >= HELD_NAMES:
                        yield named(held)
                        held = []
        if held:
            yield named(held)

    return parts.select("cells", "at").mapInArrow(name, ", ".join(f"{c} long" for c in [*_KEY, "level", "cell"])).distinct()


# -- Automata -------------------------------------------------------------------

_BUILT: dict[str, "_Automaton"] = {}


class _Automaton:
    """All phrases of a shard (a row of ``LONGEST`` cells each, 0 behind its words), the language being part of a cell.

    A word is three letters, of which the first is of an alphabet of its own: it guards the word's border, so that no
    match begins within a word or ends in one.  Letters are few, so a node's children are found fast.
    """

    def __init__(self, phrases: np.ndarray):
        self.words = np.unique(phrases)
        self.words = self.words[self.words != 0]
        size = 2
        while size**3 < len(self.words):
            size += 1
        number = np.arange(len(self.words))
        letters = np.stack([number // size**2, size + number // size % size, size + number % size], 1) + 0x100
        # The last one stands for words of no phrase and for breaks.
        self.letters = np.concatenate([letters, np.full((1, 3), ord(" "))]).astype("<u4")
        self.machine = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        self.phrases = len(phrases)
        sizes = np.count_nonzero(phrases, axis=1)
        body = self._written(self._places(phrases.ravel()))
        for i, n in enumerate(sizes.tolist()):
            start = 3 * LONGEST * i
            self.machine.add_word(body[start : start + 3 * n], i)
        self.machine.make_automaton()

    def _places(self, cells: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.words, cells), len(self.words) - 1)
        return np.where(self.words[at] == cells, at, len(self.words))

    def _written(self, places: np.ndarray) -> str:
        return self.letters[places].tobytes().decode("utf-32-le")

    def counts(self, cells: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each phrase comes in a part of text: words of ``cells``, where they come."""
        places = self._places(cells)[at]
        known = places != len(self.words)
        places = places[known | np.r_[True, known[:-1]]]
        return np.bincount(np.fromiter((i for _, i in self.machine.iter(self._written(places))), np.int64), minlength=self.phrases)


def _automaton(name: str, phrases: np.ndarray) -> _Automaton:
    """The automaton of a shard of phrases; a worker keeps that of one shard."""
    if name not in _BUILT:
        _BUILT.clear()
        _BUILT[name] = _Automaton(phrases)
    return _BUILT[name]


def occurrences(parts: DataFrame, shard: Broadcast, least: int) -> DataFrame:
    """``_KEY``, n: how often each phrase of a shard (its name and rows of cells) comes, if ``least`` times.

    A task's counts are arrays over ``BLOCK`` phrases each, in the order of the shard, so no phrase is sent to be summed.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = _automaton(*shard.value)
        total = np.zeros(machine.phrases, np.int64)
        for cells, at in _coded_words(batches):
            total += machine.counts(cells.view(np.int64), at)
        blocks = range(0, len(total), BLOCK)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(blocks)), pa.int64()), pa.array([total[i : i + BLOCK] for i in blocks], pa.list_(pa.int64()))], names=["key", "values"])

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = shard.value[1]
        for batch in batches:
            for key, row in zip(batch.column("key").to_pylist(), batch.column("values")):
                n = row.values.to_numpy()
                often = np.flatnonzero(n >= least)
                yield pa.RecordBatch.from_arrays([*(pa.array(c) for c in phrases[key * BLOCK + often].T), pa.array(n[often])], names=[*_KEY, "n"])

    return summed(parts.select("cells", "at").mapInArrow(count, "key long, values array<long>")).mapInArrow(name, ", ".join(f"{c} long" for c in [*_KEY, "n"]))


def _exact(parts: DataFrame, named: DataFrame, least: int) -> DataFrame:
    """``_KEY``, n: the phrases of ``named`` that come ``least`` times, dealt by their first two words to as many shards as they need."""
    shards = -(-named.count() * 8 * LONGEST // AUTOMATON_BYTES)
    counts = named.select(*_KEY, F.lit(0).cast("long").alias("n")).where("false")
    for s in range(shards):
        of_shard = named.where(F.pmod(F.xxhash64(*_KEY[:2]), F.lit(shards)) == s).select(*_KEY).toArrow()
        if of_shard.num_rows:
            shard = parts.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, np.stack([c.to_numpy() for c in of_shard.columns], 1)))
            counts = counts.union(write_table(occurrences(parts, shard, least), "phrases"))
            shard.unpersist()
    return counts


def phrase_counts(parts: DataFrame, words: DataFrame, least: int) -> DataFrame:
    """lang, phrase, n: all sequences of 2 to ``LONGEST`` words that come ``least`` times or more, counted exactly.

    ``words`` are those that come as often, as ``word_counts`` gives them, each with a cell that no other word of the texts has.  Each part of text first names a few of its
    candidates.  A cell whose count exceeds those of the phrases named for it by ``least`` or more may hide another: of
    such cells every part names all, so nothing is missed.  Driver and tasks hold filters of fixed size and one shard of
    candidates at a time.
    """
    spark = parts.sparkSession
    send = spark.sparkContext.broadcast
    frequent = send(cell_filter(words))
    filters: list[Broadcast] = []
    left = None
    for level in range(2, LONGEST + 1):
        often = write_table(level_cells(parts, frequent, filters, least), "frequent").withColumn("level", F.lit(level).cast("long"))
        filters.append(send(cell_filter(often)))
        left = often if left is None else left.union(often)
    known, counts = None, None
    for thin in (THIN, 1):
        wanted = filters if known is None else [send(cell_filter(left.where(F.col("level") == level))) for level in range(2, LONGEST + 1)]
        named = write_table(candidates(parts, frequent, filters, wanted, thin), "candidates")
        if known is not None:
            named = write_table(named.join(known.select(*_KEY), _KEY, "left_anti"), "candidates")
        found = _exact(parts, named, least)
        counts = found if counts is None else counts.union(found)
        known = named if known is None else known.union(named)
        got = named.join(found, _KEY).groupBy("level", "cell").agg(F.sum("n").alias("_n"))
        left = left.join(got, ["level", "cell"], "left").select("level", "cell", (F.col("n") - F.coalesce("_n", F.lit(0))).alias("n")).where(F.col("n") >= least)
        left = write_table(left, "left")
        if left.isEmpty():
            break
    for sent in {id(x): x for x in (frequent, *filters, *wanted)}.values():
        sent.unpersist()
    place = counts.select(*_KEY, "n", F.posexplode(F.array(*_KEY)).alias("_place", "cell")).where("cell <> 0")
    said = place.join(words.select("cell", "lang", "word"), "cell").groupBy(*_KEY, "n").agg(F.max("lang").alias("lang"), F.array_sort(F.collect_list(F.struct("_place", "word"))).alias("_said"))
    return said.select("lang", F.array_join(F.col("_said.word"), " ").alias("phrase"), "n")


def score(a: str, n: str, left: str, right: str) -> Column:
    """floor(1000 a n / (left right)) of columns of counts up to 10^15, exactly."""
    exact = lambda c: F.col(c).cast("decimal(15,0)")
    return F.call_function("div", F.lit(1000).cast("decimal(4,0)") * exact(a) * exact(n), exact(left) * exact(right))


def collocations(docs: DataFrame, least: int = 100, top: int = 2000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the ``top`` phrases of each lang of ``docs`` (text, lang; null: ``und``).

    A-Z are lower-cased, texts (null: empty) break into pieces at ``.,;:!?`` and line ends, pieces into words at
    spaces and tabs.  A phrase has 2 to ``LONGEST`` words of one piece and comes a >= ``least`` times.  Cut after k
    words, its parts come l and r times: it scores floor(1000 a n / (l r)) with n words in the language; the cut of
    the least score counts, the first of several.  A phrase goes if a longer one that comes as often holds it.
    Order: score and a descending, phrase by its bytes.  Repeated rows count as often as they come.

    A phrase lies in a longer one that comes as often only if it does in one of a single word more, as the phrases
    between come no less often than the longer one and no more than the shorter one.
    """
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), "text")
    for salt in numbers(FIRST_SALT):
        with set_for(docs.sparkSession, {_ROWS: str(TEXT_ROWS)}):
            parts = write_table(coded(texts, salt), "parts", compression="zstd")
        with set_for(docs.sparkSession, {_ROWS: str(PART_ROWS), _READ: str(PART_ROWS)}):
            every = write_table(word_counts(parts), "words")
            if every.groupBy("cell").count().where("count > 1").isEmpty():
                totals = write_table(every.groupBy(F.col("lang").alias("_of")).agg(F.sum("n").alias("n")), "totals")
                words = write_table(every.where(F.col("n") >= least), "words")
                discard(every)
                phrases = write_table(phrase_counts(parts, words, least), "phrases")
                break
        discard(parts)
        discard(every)
    discard(parts)
    known = phrases.union(words.select("lang", "word", "n"))
    said = F.split("phrase", " ")
    piece = lambda start, size: F.array_join(F.slice(said, start, size), " ")
    size = F.size(said)
    # What a longer phrase that comes as often holds goes.
    inside = phrases.where(size > 2).select(F.col("lang").alias("_l"), F.explode(F.array(piece(F.lit(1), size - 1), piece(F.lit(2), size - 1))).alias("_p"), F.col("n").alias("_n"))
    lone = phrases.join(inside, (F.col("lang") == F.col("_l")) & (F.col("phrase") == F.col("_p")) & (F.col("n") == F.col("_n")), "left_anti")
    cuts = lone.select("lang", "phrase", F.col("n").alias("a"), F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", piece(F.lit(1), F.col("k")).alias("_first"), piece(F.col("k") + 1, size - F.col("k")).alias("_rest"))
    part = lambda c: known.select(F.col("lang").alias(f"_lang{c}"), F.col("phrase").alias(f"_part{c}"), F.col("n").alias(c))
    cuts = cuts.join(part("l"), (F.col("lang") == F.col("_langl")) & (F.col("_first") == F.col("_partl")))
    cuts = cuts.join(part("r"), (F.col("lang") == F.col("_langr")) & (F.col("_rest") == F.col("_partr")))
    cuts = cuts.join(totals, F.col("lang") == F.col("_of"))
    best = cuts.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct(score("a", "n", "l", "r").alias("score"), "k", "l", "r")).alias("cut"))
    ranked = best.select("lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", F.col("cut.score").alias("score"), (-F.col("cut.score")).alias("_s"), (-F.col("a")).alias("_a"))
    # Languages are few, but one may have most phrases: ranks come from sorted ranges, not from one task for each language.
    ranked = number_within(ranked, ["lang"], ["_s", "_a", "phrase"], "_before").where(F.col("_before") < top)
    return ranked.select("lang", (F.col("_before") + 1).alias("rank"), "phrase", "a", "l", "r", "n", "score")
