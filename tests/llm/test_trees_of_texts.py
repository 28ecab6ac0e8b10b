"""The pipeline's near-duplicates are sought by SimHash shards and BK-trees, and by MinHash where bits are further apart."""

import random

import pytest

pytest.importorskip("public_tokenizers")

from scriptloom.llm import shingles  # noqa: E402


def test_texts_that_share_no_mark_meet_in_trees(spark, monkeypatch):
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefghilmnoprstu") for _ in range(rng.randint(2, 9))) for _ in range(900)]
    rows, near, hot = [], [], " ".join(rng.choice(words) for _ in range(3000))
    for i in range(30):
        text = [rng.choice(words) for _ in range(1000)]
        rows += [(2 * i, " ".join(text)), (2 * i + 1, " ".join([*text[:-1], "changed"]))]
        near += [shingles.majority(shingles.run_hashes(shingles.text_words(t), 5)) for _, t in rows[-2:]]
    # A shard of near copies that is dealt to several blocks.
    rows += [(100 + i, f"{hot} number{i}") for i in range(40)]
    want = {2 * i for i in range(30) if (near[2 * i] ^ near[2 * i + 1]).bit_count() <= 3} | {100}
    far = {d for i in range(30) if 2 * i not in want for d in (2 * i, 2 * i + 1)}
    assert len(want) > 20
    posts = shingles.posts_of
    monkeypatch.setattr(shingles, "posts_of", lambda made, sizes: posts(made[:, :0], sizes))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = [r.doc_id for r in shingles.keep_one_of_alike(docs).collect()]
    assert set(got) == want | far and len(got) == len(want | far)


def test_pairs_of_blocks_in_trees():
    import numpy as np

    rng = np.random.default_rng(4)
    fp = rng.integers(0, 1 << 63, 40).repeat(3).astype(np.uint64)
    fp[1::3] ^= np.uint64(1 << 40)
    fp = fp & ~np.uint64(0xFFFF)
    order = np.arange(len(fp))
    size = np.sort(rng.integers(100, 130, len(fp))).astype(np.int32)
    alike = lambda a, b: int(fp[a] ^ fp[b]).bit_count() <= 3 and size[a] >= 0.8 * size[b]
    want = {(a, b) for a in order for b in order if a < b and alike(a, b)}
    part = {"shard": np.zeros(len(fp), np.int64), "size": size, "fp": fp.view(np.int64)}
    found = {(a, b) for x, y in shingles.near_in_trees(part, ("shard",), None, 0.8) for a, b in zip(x, y)}
    assert found == want
    got = set()
    for i in range(3):
        for j in range(i, 3):
            own = np.flatnonzero((order // 40 == i) | (order // 40 == j))
            unit = {c: v[own] for c, v in part.items()} | {"block": own // 40, "i": np.full(len(own), i), "j": np.full(len(own), j)}
            got |= {(own[a], own[b]) for x, y in shingles.near_in_trees(unit, ("shard", "i", "j"), None, 0.8) for a, b in zip(x, y)}
    assert got == want
