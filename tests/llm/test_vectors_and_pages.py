"""Vector operators and WARC archives against plain versions."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from scriptloom.llm import components, epsilon_join, permutation_index, warc
from scriptloom.functions.workspace import new_path

BAD = [None, [], [0.0] * 8, [float("nan")] * 8, [1.0] * 7 + [float("inf")], [1.0] * 7 + [None]]


def vectors(n=400, seed=0, dim=8):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim))
    x[50:120] = x[0] + rng.normal(scale=0.15, size=(70, dim))
    x[120:160] = x[1]
    return [[float(np.float32(v)) for v in row] for row in x]


@pytest.fixture(scope="module")
def table(spark):
    rows = [(i, v, i % 3) for i, v in enumerate(vectors())] + [(1000 + i, v, None) for i, v in enumerate(BAD)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").select("*", F.lit(1).alias("v"), F.lit(2).alias("id"), F.lit(3).alias("n"))


def test_epsilon_join(spark, table):
    x = np.array(vectors())
    u = x / np.linalg.norm(x, axis=1)[:, None]
    link = u @ u.T >= 0.9
    np.fill_diagonal(link, False)
    comp = np.arange(len(x))
    while True:
        new = np.array([min([comp[i], *comp[link[i]]]) for i in range(len(x))])
        if (new == comp).all():
            break
        comp = new
    want = {i: (int(link[i].sum()), int(comp[i]), bool(comp[i] == i)) for i in range(len(x))} | {1000 + i: (0, 1000 + i, True) for i in range(len(BAD))}
    for block in (37, 4096):
        got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in epsilon_join.cosine_components(table, block_rows=block).collect()}
        assert got == want
    assert epsilon_join.cosine_components(table.limit(0)).count() == 0
    assert epsilon_join.cosine_components(table.where("vec_id >= 1000")).count() == len(BAD)


def test_distant_blocks_are_skipped():
    lo = np.array([[0.0], [1.0], [5.0], [5.2]])
    runs = epsilon_join.interval_pairs(lo, lo + 0.5, 0.6)
    assert sorted((i, j) for i, a, b in runs for j in range(a, b)) == [(0, 0), (0, 1), (1, 1), (2, 2), (2, 3), (3, 3)]


def test_permutation_index(spark, table):
    x = np.array(vectors())
    for length in (1.0, 3.0):
        scaled = x * np.linspace(1, length, len(x))[:, None]
        df = spark.createDataFrame([(i, list(map(float, v))) for i, v in enumerate(scaled)] + [(2000 + i, v) for i, v in enumerate(BAD)], "vec_id long, embedding array<double>")
        got = permutation_index.nearest_neighbours(df, F.col("vec_id") % 20 == 0, k=10, pivots=64, prefix=32, least=80, block_rows=150, query_rows=7).collect()
        found = {}
        for r in got:
            found.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
        assert sorted(found) == list(range(0, 400, 20))
        hits = 0
        for q, rows in found.items():
            score = scaled @ scaled[q]
            assert [k for k, _, _ in sorted(rows)] == list(range(1, 11))
            assert all(abs(s - score[v]) < 1e-9 and v != q for _, v, s in rows)
            assert sorted(rows) == [(i + 1, v, s) for i, (v, s) in enumerate(sorted(((v, s) for _, v, s in rows), key=lambda t: (-t[1], t[0])))]
            order = [v for v in np.lexsort((np.arange(400), -score)) if v != q][:10]
            hits += len(set(order) & {v for _, v, _ in rows})
        assert hits / (10 * len(found)) >= 0.9


def test_index_of_few_or_no_rows(spark, table):
    few = table.where("vec_id < 3")
    got = permutation_index.nearest_neighbours(few, F.col("vec_id") == 0, k=20).collect()
    assert sorted(r.vec_id for r in got) == [1, 2]
    assert permutation_index.nearest_neighbours(table.limit(0), F.col("vec_id") == 0).count() == 0
    assert permutation_index.nearest_neighbours(table.where("vec_id >= 1000"), F.lit(True)).count() == 0


def test_ties_go_to_the_smaller_id(spark):
    df = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(50)], "vec_id long, embedding array<double>")
    got = permutation_index.nearest_neighbours(df, F.col("vec_id") == 20, k=5).orderBy("rank").collect()
    assert [r.vec_id for r in got] == [0, 1, 2, 3, 4]


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(60)] + [(i, i + 1) for i in range(100, 160)] + [(200, i) for i in range(201, 260)] + [(7, 7)]
    df = spark.createDataFrame([*edges, (None, 3)], "a long, b long")
    got = {r.node: r.component for r in components.connected_components(df).collect()}
    label = {x: x for e in edges if e[0] != e[1] for x in e}
    for _ in range(200):
        for a, b in edges:
            if a != b:
                label[a] = label[b] = min(label[a], label[b])
    assert got == label


def pages():
    rng = random.Random(8)
    big = ["".join(rng.choice("abcdé\r\n ") for _ in range(rng.randint(1000, 5000))) for _ in range(12)]
    rows = [(i, f"http://x/{i}", big[i % 12] if i % 4 else "small" * (i % 5)) for i in range(80)]
    rows += [(80, None, None), (81, "http://x/\r\nevil: 1", ""), (82, "u", "WARC/1.0\r\n\r\n\r\n\r\n" * 100), (83, "u", "x" * 300_000), (84, "u", "x" * 300_000), (5, "again", rows[5][2]), (6, "six", "other")]
    return rows


def plain_archive(rows):
    out = []
    owner = {}
    for p, _, h in rows:
        b = (h or "").encode()
        if len(b) >= 1000:
            owner[b] = max(owner.get(b, -1), p)
    for p, _, h in rows:
        b = (h or "").encode()
        refers = owner[b] if b in owner and owner[b] != p else None
        out.append((p, len(b), hashlib.sha1(b).hexdigest(), "response" if refers is None else "revisit", refers))
    return Counter(out)


def test_archives_round_trip(spark):
    rows = pages()
    df = spark.createDataFrame(rows, "page_id long, url string, html string").select("*", F.lit(1).alias("digest"), F.lit(2).alias("archive")).repartition(3)
    got = Counter(tuple(r) for r in warc.archive_pages(df).collect())
    assert got == plain_archive(rows)
    path = new_path(spark, "warc")
    index = warc.write_archives(df, path, archive_bytes=50_000)
    assert index.select("archive").distinct().count() > 3
    some = index.where("page_id % 7 = 1")
    want = Counter({k: v for k, v in plain_archive(rows).items() if k[0] % 7 == 1})
    assert Counter(tuple(r) for r in warc.read_records(spark, path, some, gap_bytes=100, range_bytes=2000).collect()) == want
    assert Counter(tuple(r) for r in warc._read_whole(spark, path, some.select("archive", "offset", "length", "digest")).collect()) == want
    assert warc.archive_pages(df.limit(0)).count() == 0


def test_records_are_checked():
    good = b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:1>\r\nWARC-Payload-Digest: sha1:%s\r\nContent-Length: 2\r\n\r\nhi"
    digest = hashlib.sha1(b"hi").hexdigest()
    assert warc.parse_record(good % digest.encode(), digest) == (1, 2, digest, "response", None)
    with pytest.raises(ValueError):
        warc.parse_record((good % digest.encode())[:-1] + b"o", digest)
    with pytest.raises(ValueError):
        warc.parse_record(good % digest.encode(), "0" * 40)


def test_ranges_are_coalesced():
    rows = [(0, 10), (14, 6), (30, 5), (36, 100), (200, 1)]
    assert list(warc._ranges(rows, 4, 1000)) == [(0, 2, 0, 20), (2, 4, 30, 136), (4, 5, 200, 201)]
    assert list(warc._ranges(rows, 1000, 50)) == [(0, 3, 0, 35), (3, 4, 36, 136), (4, 5, 200, 201)]


def test_a_crowd_of_near_copies_hides_no_neighbours(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, 24))
    x[::3] = x[0] + rng.normal(scale=0.05, size=(1000, 24))
    x[1::30] = x[1]
    x /= np.linalg.norm(x, axis=1)[:, None]
    df = spark.createDataFrame([(i, list(map(float, v))) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    found = {}
    for r in permutation_index.nearest_neighbours(df, F.col("vec_id") % 20 == 0, k=20).collect():
        found.setdefault(r.query_id, []).append(r.vec_id)
    recall = []
    for q, got in found.items():
        s = x @ x[q]
        recall.append(len(set(got) & set([v for v in np.lexsort((np.arange(3000), -s)) if v != q][:20])) / 20)
    assert len(recall) == 150 and np.mean(recall) >= 0.9 and np.mean([r < 0.7 for r in recall]) < 0.05
