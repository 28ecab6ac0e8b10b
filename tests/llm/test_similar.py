"""Similar lines are found however far apart word SimHashes are, whatever is replaced in them."""

import random

import pytest

pytest.importorskip("public_tokenizers")

from scriptloom.llm import line_dedup  # noqa: E402


def words_of(rng, n):
    return ["".join(rng.choice("abcdefghilmnoprstu") for _ in range(rng.randint(2, 9))) for _ in range(n)]


def similar_lines():
    """Lines and each one's copy with a tenth of its characters at most in other words."""
    rng = random.Random(5)
    words = words_of(rng, 900)
    rows = []
    for i in range(240):
        line = [rng.choice(words) for _ in range(rng.randint(6, 40))]
        other = list(line)
        k = rng.randrange(len(line))
        other[k] = rng.choice([w for w in words if len(w) > 3])
        a, b = " ".join(line), " ".join(other)
        if a != b and len(a) >= 16 and line_dedup.similar(a, b, 0.9):
            rows += [(2 * i, a), (2 * i + 1, b)]
    return rows


def test_similar_lines(spark, tmp_path):
    from scriptloom.llm.queries import QUERIES

    rows = similar_lines()
    assert len(rows) > 100
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    gone = {r.doc_id for r in QUERIES["op6_line_dedup"](spark, f"{tmp_path}").collect() if r.n_removed}
    assert gone == {d for d, _ in rows if d % 2}


def changed(rng, line, share):
    """``line`` with a share of its characters replaced, dropped or doubled, here and there."""
    out = list(line)
    for i in rng.sample(range(len(line)), int(share * len(line))):
        out[i] = rng.choice(["", out[i] * 2, rng.choice("abcdefghilmnoprstu")])
    return "".join(out)


@pytest.mark.parametrize("low, high, share, least", [(10, 19, 0.099, 1.0), (20, 56, 0.05, 0.9), (64, 200, 0.03, 0.97), (200, 600, 0.05, 0.9)])
def test_recall_of_candidates(spark, low, high, share, least):
    """Of lines with scattered changes: those that a copy is found of."""
    rng = random.Random(low)
    words = words_of(rng, 900)
    rows = []
    while len(rows) < 400:
        text = " ".join(rng.choice(words) for _ in range(120))[: rng.randint(low, high)].strip()
        other = " ".join(changed(rng, text, share).split())
        if len(text) >= low and other != text and line_dedup.similar(text, other, 0.9):
            rows += [(len(rows), text), (len(rows) + 1, other)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    removed = line_dedup.line_report(docs).where("n_removed > 0").count()
    assert removed >= least * len(rows) / 2
