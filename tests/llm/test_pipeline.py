"""The pipeline's stages take effect and keep what they should."""

import random

import pytest

pytest.importorskip("public_tokenizers")

import corpus_pipeline  # noqa: E402
from scriptloom.llm.queries import ORACLES, QUERIES  # noqa: E402

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefghilmnoprstu") for _ in range(rng.randint(2, 9))) for _ in range(900)]
    line = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows = [(i, "\n".join(line(rng.randint(20, 60)) for _ in range(3)), "en", f"s{i % 3 if i % 2 else 0}", 0) for i in range(60)]
    banner = "please subscribe to our weekly newsletter about everything"
    rows = [(d, f"{t}\n{banner}" if d < 20 else t, *rest) for d, t, *rest in rows]
    rows += [(100, rows[30][1], "en", "s1", 0), (101, None, "en", "s1", 0), (102, "12345 67890 +++", "en", "s2", 0), (103, rows[31][1].upper(), "en", "s2", 0)]
    path = tmp_path_factory.mktemp("data")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    return f"{path}"


def test_stages(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, docs, folder)
        made.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = docs.collect()
        if name != "sequences":
            assert docs.columns == COLUMNS
    clean = set(range(60))
    assert {r.doc_id for r in seen["language"]} == clean | {100, 103}
    kept = {r.doc_id: r.text for r in seen["lines"]}
    assert set(kept) == clean and sum("newsletter" in t for t in kept.values()) == 1 and kept[40] == next(r.text for r in seen["language"] if r.doc_id == 40)
    assert {r.doc_id for r in seen["near_duplicates"]} == clean
    copies = [r.doc_id for r in seen["mixture"]]
    assert set(copies) == clean and len(copies) > 60 and max(copies.count(d) for d in clean) <= 3
    assert {r.doc_id for r in seen["sequences"]} == clean
    ran = corpus_pipeline.run(spark, folder)
    key = lambda rows: sorted((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows)
    assert key(ran.collect()) == key(seen["sequences"])


def test_registered():
    assert {int(n[2:].split("_")[0]) for n in QUERIES} == set(range(1, 11)) and set(ORACLES) <= set(QUERIES)
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
