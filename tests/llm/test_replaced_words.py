"""Lines of which words were replaced need no table of distances, posts that are alone are dropped first, and runs are hashed where they lie."""

import random

import numpy as np
import pyarrow as pa

from scriptloom.llm import line_dedup, minhash


def pairs(rng, n):
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7))) for _ in range(40)]
    out = []
    for _ in range(n):
        a = [rng.choice(words) for _ in range(rng.randint(3, 30))]
        b = list(a)
        for _ in range(rng.randint(0, 5)):
            k = rng.randrange(len(b) + 1)
            b[k : k + rng.randint(0, 2)] = [rng.choice(words) for _ in range(rng.randint(0, 2))]
        out.append((" ".join(a), " ".join(b) or "a"))
    return out


def test_replaced_words_are_one_way():
    found = 0
    for a, b in pairs(random.Random(1), 3000):
        d, most = line_dedup.edit_distance(a, b, 10_000), max(len(a), len(b)) // 10
        if line_dedup.replaced(a, b, most):
            assert d <= most
            found += 1
    assert found > 300 and line_dedup.replaced("x", "x", 0) and not line_dedup.replaced("x y", "z y", 0)


def test_distances_over_limits_of_their_own():
    some = pairs(random.Random(2), 600)
    some += [(b, a) for a, b in some[:100]]
    limits = np.array([max(len(a), len(b)) // 10 for a, b in some])
    got = line_dedup.distances([a for a, _ in some], [b for _, b in some], int(limits.max()), limits)
    want = np.array([line_dedup.edit_distance(a, b, 10_000) for a, b in some])
    assert ((got <= limits) == (want <= limits)).all() and (got == want)[want <= limits].all() and 100 < (want <= limits).sum() < 600


def test_no_table_for_replaced_words(monkeypatch):
    rng = random.Random(3)
    lines = []
    for i in range(20):
        a = [f"{rng.randrange(10**6):06d}" for _ in range(30)]
        b = list(a)
        b[4], b[21] = "wander", "stones"
        lines += [" ".join(a), " ".join(b)]
    monkeypatch.setattr(line_dedup, "distances", None)
    _, alike = line_dedup.edit_tests(0.9)(np.array(lines, object), np.array([len(x) for x in lines]))
    assert alike(np.arange(0, 40, 2), np.arange(1, 40, 2)).all()


def test_posts_that_are_alone_go():
    rng = np.random.default_rng(4)
    for _ in range(200):
        n = int(rng.integers(0, 30))
        post = np.sort(rng.integers(0, 12, n) << minhash.SIZE_BITS | rng.integers(1, 9, n))
        batch = pa.record_batch({c: pa.array(post if c == "post" else np.arange(n), pa.int64()) for c in ("post", "id", "fp", "sketch")})
        cuts = [0, *np.sort(rng.integers(0, n + 1, 5)).tolist(), n]
        made = minhash.in_company(batch.slice(s, e - s) for s, e in zip(cuts, cuts[1:]))
        got = [r for b in made for r in zip(*(b.column(c).to_pylist() for c in ("id", "shard", "size")))]
        shard, size = post >> minhash.SIZE_BITS, post & ((1 << minhash.SIZE_BITS) - 1)
        assert got == [(i, shard[i], size[i]) for i in range(n) if (shard == shard[i]).sum() > 1]


def test_runs_where_they_lie():
    data = np.random.default_rng(5).integers(97, 122, 3000).astype(np.uint8)
    padded = np.concatenate([data, np.zeros(16, np.uint8)])
    eight = np.ndarray((len(padded) - 8,), np.uint64, padded, 0, (1,)).copy()
    sizes = np.full(60, 50)
    starts = np.arange(60) * 50
    for width in (4, 6, 8, 12):
        whole, first = line_dedup.runs_of_bytes(eight, starts, sizes, width)
        few, at = line_dedup.runs_of_bytes(eight, starts[::20], sizes[::20], width)
        assert len(whole) == 60 * (51 - width) and first.tolist() == [k * (51 - width) for k in range(60)]
        assert few.tolist() == np.concatenate([whole[first[k] : first[k] + 51 - width] for k in (0, 20, 40)]).tolist() and len(at) == 3
