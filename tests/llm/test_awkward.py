"""The registered queries and the pipeline's stages on tables with every awkward row, and on empty ones."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

import corpus_pipeline  # noqa: E402
from scriptloom.llm import language_id, sharding, simhash  # noqa: E402
from scriptloom.llm.queries import QUERIES  # noqa: E402

#: Names that operators use themselves.
CLASH = "removed int, size int, row int, key int, n_links int, component_id int, kept boolean, score double, digest string, _n int"
CLASHING = (1, 2, 3, 4, 5, 6, True, 0.5, "d", 7)
DOCUMENTS = f"doc_id long, text string, lang string, source string, n_chars long, {CLASH}"
EMBEDDINGS = f"vec_id long, embedding array<float>, label int, {CLASH}"
PAGES = f"page_id long, url string, html string, {CLASH}"


def documents():
    rng = random.Random(8)
    words = {x: ["".join(rng.choice(letters) for _ in range(rng.randint(2, 8))) for _ in range(300)] for x, letters in (("en", "abcdefghilmnoprstu"), ("fr", "éèàçabdeilmnopqrsu"))}
    line = lambda lang, n: " ".join(rng.choice(words[lang]) for _ in range(n))
    rows = [(i, "\n".join(line("en" if i % 2 else "fr", rng.randint(8, 30)) for _ in range(3)), "en" if i % 2 else "fr", f"s{i % 3}") for i in range(40)]
    long = line("en", 30_000) + "y" * 2000 + " " + line("en", 2000)
    rows += [(50, None, "en", "s0"), (51, "", "en", "s1"), (52, " \n ", None, None), (53, "12 34", "fr", "s1"), (54, long, "en", "s2"), (55, long + " end", "en", None)]
    rows += [(56, rows[3][1], "en", "s0"), (56, rows[3][1], "en", "s0"), (None, line("en", 30), "en", "s1"), (None, rows[5][1], None, "s1"), (57, rows[7][1].upper(), "en", "s2"), (58, "a", "en", "s2")]
    return [(d, t, x, s, len(t or ""), *CLASHING) for d, t, x, s in rows]


def embeddings():
    rng = np.random.default_rng(3)
    v = rng.normal(size=(60, 6)).round(3)
    rows = [(i, v[i].tolist()) for i in range(60)] + [(60 + i, (v[i] * (1 + i)).tolist()) for i in range(6)]
    rows += [(70, None), (71, []), (72, [0.0] * 6), (73, [float("nan")] + [1.0] * 5), (74, [None] + [1.0] * 5), (75, [float("inf")] * 6), (5, v[5].tolist()), (5, v[9].tolist()), (None, v[4].tolist()), (None, None), (80, [1.0, 2.0])]
    return [(i, x, 0, *CLASHING) for i, x in rows]


def pages():
    body = "<p>" + "hello world " * 120 + "</p>"
    rows = [(i, f"http://h/{i}", body if i % 3 == 0 else f"<b>{i}</b>" * 150) for i in range(30)]
    rows += [(40, None, None), (41, "u\r\nx", ""), (42, "u", "é" * 600), (42, "u", "é" * 600), (42, "v", "other"), (None, "n", body), (None, "n", body), (None, None, None), (43, "w", "\r\n\r\n" * 300)]
    return [(*r, *CLASHING) for r in rows]


def labels():
    return [(i, i % 3 - 1 if i % 5 else None, i % 2, *CLASHING) for i in range(0, 60, 2)] + [(56, 1, 1, *CLASHING), (None, 1, 1, *CLASHING), (999, 1, 1, *CLASHING)]


LABELS = f"doc_id long, quality int, toxic int, {CLASH}"
TABLES = {"labels": (labels, LABELS), "documents": (documents, DOCUMENTS), "embeddings": (embeddings, EMBEDDINGS), "pages": (pages, PAGES)}


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    full, none = tmp_path_factory.mktemp("awkward"), tmp_path_factory.mktemp("empty")
    for name, (rows, schema) in TABLES.items():
        spark.createDataFrame(rows(), schema).repartition(3).write.parquet(f"{full}/{name}.parquet")
        spark.createDataFrame([], schema).write.parquet(f"{none}/{name}.parquet")
    return f"{full}", f"{none}"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, folders, name):
    full, none = folders
    got = QUERIES[name](spark, full).collect()
    n = int(name[2:].split("_")[0])
    docs = Counter(r[0] for r in documents())
    if n in (1, 3, 5, 6, 8, 12):
        assert Counter(r.doc_id for r in got) == docs
    if n == 1:
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
        want = [(d, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for d, t, *_ in documents()]
        assert Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in got) == Counter(want)
    if n == 5:
        want = Counter((d, f"{simhash.fingerprint(t):016x}") for d, t, *_ in documents())
        assert Counter((r.doc_id, r.fingerprint) for r in got) == want
    if n in (2, 7):
        assert {r.doc_id for r in got} == set(docs)
    if n == 9:
        assert Counter(r.vec_id for r in got) == Counter(r[0] for r in embeddings())
        links = {r.vec_id: r.n_links for r in got if r.vec_id in (70, 71, 72, 73, 74, 75)}
        assert set(links.values()) == {0}
    if n == 10:
        sha = lambda h: hashlib.sha1((h or "").encode()).hexdigest()
        assert Counter((r.page_id, r.payload_bytes, r.payload_digest) for r in got) == Counter((p, len((h or "").encode()), sha(h)) for p, _, h, *_ in pages())
        assert {r.refers_to for r in got if r.record_type == "revisit"} == {27}
        assert Counter(r.page_id for r in got if r.record_type == "response")[42] == 3
    if n == 11:
        first = [r for r in got if r.filter_order == "EABCD" and r.step == 1]
        assert {r.part for r in got} == {"", "s0", "s1", "s2"} and len(got) == 4 * 600
        # Repeats: 51 of 50, and both rows of 56 of 3.
        assert sum(r.removed for r in first) == 3 and sum(r.kept + r.removed for r in first) == len(documents())
    if n == 12:
        assert all((r.n_assign, r.n_access, r.spans) == (0, 0, "") for r in got if r.doc_id in (50, 51, 52, 58))
    assert QUERIES[name](spark, none).count() == 0


def test_stages_on_awkward_and_empty_tables(spark, folders):
    full, none = folders
    docs, empty = (spark.read.parquet(f"{x}/documents.parquet") for x in folders)
    rows = Counter(r[0] for r in documents())
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, docs, full)
        got = Counter(r.doc_id for r in made.collect())
        if name != "sequences":
            assert made.columns == docs.columns
        if name == "language":
            assert set(rows) - set(got) == {50, 51, 52, 53} and got[56] == 2 and got[None] == 2
        if name == "lines":
            assert got[50] == got[51] == got[52] == 1 and 56 not in got and 57 not in got and got[None] == 2 and 5 not in got
        if name == "near_duplicates":
            assert got[None] == 2 and 55 not in got and got[54] == got[3] == got[50] == 1 and not {51, 52, 56, 57} & set(got)
        if name in ("mixture", "sequences"):
            assert all(got[d] >= k for d, k in rows.items())
        assert stage(spark, empty, none).count() == 0


def test_a_result_outlives_a_run_of_the_pipeline(spark, folders):
    held = QUERIES["op5_simhash"](spark, folders[0])
    corpus_pipeline.run(spark, folders[0]).count()
    corpus_pipeline.language(spark, spark.read.parquet(f"{folders[0]}/documents.parquet"), folders[0]).count()
    assert held.count() == len(documents())


def test_prediction_is_binding_bundling_and_cosine():
    """One text's bundle and one cosine, trigram by trigram."""
    vectors = language_id.HyperVectors(256, 7)
    text = "Le château, été 12 d'où!"
    plain = np.zeros(256)
    folded = " " + " ".join("".join(c.lower() if c.isalpha() else " " for c in text).split()) + " "
    for a, b, c in zip(folded, folded[1:], folded[2:]):
        letter = lambda x: vectors.letter(ord(x)).astype(int)
        plain += np.roll(letter(a), 2) * np.roll(letter(b), 1) * letter(c)
    assert (vectors.bundle([text])[0] == plain).all()


def test_leaves_against_a_plain_tree(spark):
    """A k-d tree by sorting, on distinct values without ties: the same cuts, but for a leaf's tolerance."""
    rng = random.Random(4)
    rows = [(i, rng.randrange(10**6), rng.randrange(10**3), rng.randrange(2**40), rng.randint(1, 50)) for i in range(3000)]
    table = spark.createDataFrame(rows, "id long, x long, y long, tie long, w long")
    got = {r.id: r.leaf for r in sharding.kd_leaves(table, ["x", "y"], "tie", "id", "w", 8, tolerance=0.001).collect()}
    extent = {d: max(r[d] for r in rows) - min(r[d] for r in rows) for d in (1, 2)}
    plain = {}

    def split(part, first, k):
        if k == 1:
            plain.update({r[0]: first for r in part})
            return
        d = max((1, 2), key=lambda c: (max(r[c] for r in part) - min(r[c] for r in part)) / extent[c])
        part = sorted(part, key=lambda r: (r[d], r[3], r[0]))
        total, below, cut = sum(r[4] for r in part), 0, 0
        while below + part[cut][4] / 2 < total * (k // 2) / k:
            below += part[cut][4]
            cut += 1
        split(part[:cut], first, k // 2)
        split(part[cut:], first + k // 2, k - k // 2)

    split(rows, 0, 8)
    weight = Counter()
    for r in rows:
        weight[got[r[0]]] += r[4]
    assert sum(got[i] == plain[i] for i in got) > 0.97 * len(rows)
    assert max(weight.values()) <= 1.01 * min(weight.values()) + 50
