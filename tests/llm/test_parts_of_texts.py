"""Parts of text of the collocations: they span batches, hold a bounded amount and lose no text."""

import pyarrow as pa

from scriptloom.llm import collocations


def batches(rows, size):
    for i in range(0, len(rows), size):
        langs, texts = zip(*rows[i : i + size])
        yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(texts, pa.string())], names=["lang", "text"])


def pieces(parts):
    return sorted((lang, p) for lang, body in parts for p in body.decode().split(" . ") if p)


def test_parts_span_batches():
    rows = [(("en", "fr")[i % 2], f"w{i} the end") for i in range(100)] + [("en", None), ("fr", " .")]
    parts = list(collocations._parts(batches(rows, 8)))
    assert sorted(lang for lang, _ in parts) == ["en", "fr"]
    assert sorted((lang, p.removesuffix(" .")) for lang, p in pieces(parts)) == sorted((lang, t) for lang, t in rows if t and t != " .")


def test_held_text_is_bounded(monkeypatch):
    monkeypatch.setattr(collocations, "PART_BYTES", 100)
    monkeypatch.setattr(collocations, "HELD_BYTES", 300)
    monkeypatch.setattr(collocations, "LANG_BYTES", 20)
    rows = [(f"l{i % 40}", f"word{i} " * (1 + 30 * (i == 77))) for i in range(400)]
    parts = list(collocations._parts(batches(rows, 16)))
    assert sorted((lang, p.removesuffix(" .")) for lang, p in pieces(parts)) == sorted((lang, t.strip()) for lang, t in rows)
    assert all(len(body) <= 130 or body.count(b" . ") == 0 for _, body in parts) and len(parts) > 40


def test_words_hash_like_spark(spark):
    from pyspark.sql import functions as F

    words = ["a", "é", "zz z", "長い", "x" * 100]
    rows = spark.createDataFrame([("fr", w) for w in words], "lang string, word string").select(F.xxhash64("lang", "word").alias("h")).collect()
    coded = pa.array(words, pa.large_string()).dictionary_encode()
    every = collocations.cell_filter(spark.createDataFrame([(r.h,) for r in rows], "cell long"))
    assert collocations._word_cells("fr", coded, every).view("int64").tolist() == [r.h for r in rows]
