"""Collocations read texts once: automata of many phrases run over parts whose words are numbers."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from scriptloom.llm import collocations

LINES = [("en", "the cat sat on the mat. the cat ran, the cat sat"), ("fr", "le chat et le chat. the cat"), (None, "a a a a a; a a"), ("en", None)] * 9


def phrases(lines, least):
    found = Counter()
    for lang, text in lines:
        for piece in (text or "").replace(",", ".").replace(";", ".").split("."):
            words = piece.split()
            found.update((lang or "und", " ".join(words[i : i + k])) for k in range(2, 6) for i in range(len(words) - k + 1))
    return {p: n for p, n in found.items() if n >= least}


@pytest.mark.parametrize("salt, bytes_of_automaton", [(0, 200), (3, 1 << 20)])
def test_texts_are_read_once(spark, monkeypatch, salt, bytes_of_automaton):
    """However many automata there are, and whichever hash the words have."""
    read, parts_of = spark.sparkContext.accumulator(0), collocations._parts

    def counted(batches):
        def seen():
            for b in batches:
                read.add(b.num_rows)
                yield b

        return parts_of(seen())

    monkeypatch.setattr(collocations, "_parts", counted)
    monkeypatch.setattr(collocations, "AUTOMATON_BYTES", bytes_of_automaton)
    monkeypatch.setattr(collocations, "FIRST_SALT", salt, raising=False)
    docs = spark.createDataFrame(LINES, "lang string, text string").repartition(3)
    docs = docs.select("lang", "text", F.lit(1).alias("n"))
    got = {(r.lang, r.phrase): r.a for r in collocations.collocations(docs, least=9).collect()}
    want = phrases(LINES, 9)
    assert got and all(want[p] == n for p, n in got.items())
    assert read.value == len(LINES)


def test_words_guard_their_borders():
    """Of 300 words, whose letters recur in each other, phrases are found where their words are, overlapping ones too."""
    rng = np.random.default_rng(1)
    cells = np.unique(rng.integers(1, 1 << 62, 300))
    text = rng.integers(0, len(cells), 20_000) % 40
    rows = {tuple(cells[text[i : i + k]].tolist()) for i in range(0, 4000, 7) for k in range(2, 6)} | {(int(c), int(c)) for c in cells}
    table = np.array([[*r, *[0] * (5 - len(r))] for r in sorted(rows)])
    known = np.concatenate([[0], cells])
    at = np.where(np.arange(len(text)) % 50 == 0, 0, text + 1)
    want = Counter(tuple(known[at[i : i + k]].tolist()) for k in range(2, 6) for i in range(len(at) - k + 1))
    got = collocations._Automaton(table).counts(known, at)
    assert got.tolist() == [want[r] for r in sorted(rows)]
