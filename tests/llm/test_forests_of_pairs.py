"""Pairs are compared forest by forest: all links are found, and none of a group of copies is compared in vain."""

import numpy as np

from scriptloom.llm import minhash
from scriptloom.llm.bk_tree import Union


def decide(n, a, b, alike):
    union, edges, seen = Union(n), [], []

    def test(u, v):
        seen.extend(zip(u.tolist(), v.tolist()))
        return alike(u, v)

    minhash.decided(union, edges, np.array(a), np.array(b), np.zeros(n, np.int64), test)
    return union.roots(np.arange(n)).tolist(), edges, seen


def test_forest():
    a, b = np.array([1, 2, 1, 5, 5, 4]), np.array([2, 3, 3, 5, 4, 1])
    assert minhash.forest(a, b).tolist() == [True, True, False, False, True, True]


def test_a_group_of_copies_takes_a_forest():
    n = 60
    a, b = np.triu_indices(n, 1)
    roots, edges, seen = decide(n, a, b, lambda u, v: np.ones(len(u), bool))
    assert roots == [0] * n and len(edges) == len(seen) == n - 1


def test_every_link_between_groups_counts():
    rng = np.random.default_rng(1)
    for _ in range(50):
        n = 30
        a, b = np.triu_indices(n, 1)
        some = rng.random(len(a)) < 0.5
        a, b = a[some], b[some]
        real = {(int(x), int(y)) for x, y in zip(a, b) if rng.random() < 0.06}
        roots, edges, seen = decide(n, a, b, lambda u, v: np.array([(int(x), int(y)) in real for x, y in zip(u, v)], bool))
        want = Union(n)
        want.join_all(*map(np.array, zip(*real))) if real else None
        assert roots == want.roots(np.arange(n)).tolist() and set(edges) <= real and len(seen) == len(set(seen))
