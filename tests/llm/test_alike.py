"""The pipeline drops documents whose five-word shingles are alike, however far apart their SimHashes are."""

import random

import pytest

pytest.importorskip("public_tokenizers")

import corpus_pipeline  # noqa: E402
from scriptloom.llm import simhash  # noqa: E402


def jaccard(a, b):
    x, y = ({tuple(t.split()[i : i + 5]) for i in range(max(1, len(t.split()) - 4))} for t in (a, b))
    return len(x & y) / len(x | y)


def test_documents_alike_beyond_three_bits(spark):
    rng = random.Random(6)
    words = ["".join(rng.choice("abcdefghilmnoprstu") for _ in range(rng.randint(2, 9))) for _ in range(900)]
    rows, want, far = [(1000, None, 1), (1001, " ", 1), (None, "no id", 1)], {1000, None}, 0
    for i in range(60):
        text = [rng.choice(words) for _ in range(rng.randint(60, 200))]
        other = list(text)
        for _ in range(rng.randint(1, 6)):
            other[rng.randrange(len(other))] = rng.choice(words)
        a, b = " ".join(text), " ".join(other)
        rows += [(2 * i, a, 2), (2 * i + 1, b, 3)]
        alike = jaccard(a, b) >= 0.8
        want |= {2 * i} if alike else {2 * i, 2 * i + 1}
        far += alike and (simhash.fingerprint(a) ^ simhash.fingerprint(b)).bit_count() > 3
    assert far > 10 and len(want) > 62
    docs = spark.createDataFrame(rows, "doc_id long, text string, removed int").repartition(4)
    kept = corpus_pipeline.near_duplicates(spark, docs, "")
    assert kept.columns == docs.columns
    got = [r.doc_id for r in kept.collect()]
    assert set(got) == want and len(got) == len(want)
    assert corpus_pipeline.near_duplicates(spark, docs.limit(0), "").count() == 0
