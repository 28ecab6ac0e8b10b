"""Operators on documents: small tables with every awkward row, against plain versions."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

from scriptloom.llm import language_id, line_dedup, minhash, mixing, packing, sharding, simhash, token_counts  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def sentence(rng, words, n):
    return " ".join(rng.choice(words) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    en = "the and of that with ration shall thing often where other under stone river light".split()
    fr = "le la les été où même très château fenêtre garçon leçon être noël aujourd hui".split()
    out = []
    for i in range(60):
        lang = "en" if i % 3 else "fr"
        lines = [sentence(rng, en if lang == "en" else fr, rng.randint(4, 30)) for _ in range(rng.randint(1, 6))]
        out.append((i, "\n".join(lines), lang, f"s{i % 4}" if i % 10 else None, 0))
    long_text = sentence(rng, en, 30_000) + "x" * 3000 + " " + sentence(rng, en, 3000)
    out += [
        (100, None, "en", "s1", None), (101, "", None, "s1", 0), (102, " \n\t\n", "fr", "s2", 3), (103, "1234 !!! ###", "en", "s2", 0),
        (104, out[5][1], "en", "s0", 0), (105, out[5][1], "en", "s3", 0), (104, out[5][1], "en", "s0", 0), (106, long_text, "en", "s0", 0),
        (107, long_text + " tail", "en", "s0", 0), (108, "<|endoftext|>a<|startoftext|> b", "en", "s1", 0), (109, "日本語 テスト ４５", None, "s1", 0), (None, "no id here at all but many words", "en", "s1", 0),
        (110, "a", "en", "s1", 0), (111, out[7][1].replace("the", "The", 1), "en", "s1", 0),
    ]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    clash = {"fp": 1, "row": 2, "key": 3, "removed": 4, "score": 5, "length": 6, "component_id": 7, "_n": 8, "times": 9, "k": 10, "rank": 11}
    df = spark.createDataFrame(rows, SCHEMA)
    return df.select("*", *[F.lit(v).alias(k) for k, v in clash.items()]).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_token_counts_are_the_librarys(docs, rows, empty):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    got = sorted((r.doc_id or -1, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.token_counts(docs, path, chunk_chars=5000).collect())
    want = []
    for d, t, *_ in rows:
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        want.append((d or -1, len((t or "").encode()), n, n > 2048))
    assert got == sorted(want)
    assert token_counts.token_counts(empty, path).count() == 0


def test_state_maps_compose_in_any_way():
    machine = token_counts.compiled(public_tokenizers.path("word_bpe_49k.json"))
    rng = random.Random(1)
    text = "".join(rng.choice("aAbé '1!\n<|endoftext|>İß") for _ in range(800)) + "<|endoftext|>"
    for size in (3, 17, 200):
        maps = [machine.state_map(text[i : i + size]) for i in range(0, len(text), size)]
        assert machine.closed(machine.scan(maps)[-1]) == machine.count(text)
        for i, m in enumerate(machine.scan(maps)):
            assert machine.closed(m) == machine.count(text[: (i + 1) * size])


def test_transducer_is_merging():
    import json

    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        machine = token_counts.Transducer(json.load(f))
    rng = random.Random(2)
    for _ in range(500):
        word = "".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(1, 14))).encode()
        assert machine.count(word) == len(machine.merge((*word[:-1], word[-1] + 256)))


def test_language_of_held_out_documents(spark, docs, rows, empty):
    got = {}
    for r in language_id.identify(docs).collect():
        got.setdefault(r.doc_id, r)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1
    assert all(got[d].lang_pred == "und" and got[d].score == 0 for d in (100, 101, 102, 103))
    held = [(d, lang) for d, _, lang, *_ in rows if d is not None and d < 60 and got[d].held_out]
    assert held and sum(got[d].lang_pred == lang for d, lang in held) >= 0.9 * len(held)
    assert language_id.identify(empty).count() == 0
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in language_id.identify(unlabelled).collect()} == {"und"}


def test_language_is_never_an_input_of_its_prediction(docs):
    flipped = docs.withColumn("lang", F.when(language_id.held_out(F.col("doc_id")), "xx").otherwise(F.col("lang")))
    key = lambda df: sorted((r.doc_id or -1, r.lang_pred, round(r.score, 3)) for r in language_id.identify(df).collect())
    assert key(docs) == key(flipped)


def test_rejected_documents_go(docs):
    kept = language_id.keep_identified(docs)
    assert kept.columns == docs.columns
    ids = Counter(r.doc_id for r in kept.select("doc_id").collect())
    assert not {100, 101, 102, 103} & set(ids) and ids[104] == 2 and all(ids[i] == 1 for i in range(60))


def plain_fingerprint(text, width=3):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").translate({c: " " for c in range(9, 14)}).split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] if len(words) >= width else [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(items, linked):
    """Smallest id reachable, by brute force over all pairs of (id, value)."""
    ids = list(range(len(items)))
    while True:
        new = [min(ids[j] for j in range(len(items)) if linked(items[i][1], items[j][1])) for i in range(len(items))]
        if new == ids:
            break
        ids = new
    return [min((items[j][0] for j in range(len(items)) if ids[j] == ids[i] and items[j][0] is not None), default=None) for i in range(len(items))]


def test_simhash_components(spark, docs, rows, empty):
    prints = [(d, plain_fingerprint(t)) for d, t, *_ in rows]
    want = plain_components(prints, lambda a, b: (a ^ b).bit_count() <= 3)
    got = sorted((r.doc_id or -1, r.fp % 2**64, r.component_id) for r in simhash.simhash_components(docs).collect())
    assert got == sorted((d or -1, f, c) for (d, f), c in zip(prints, want))
    assert simhash.simhash_components(empty).count() == 0
    same_hash = spark.range(1).select(F.xxhash64(F.lit("a b c")).alias("h")).first().h
    assert same_hash % 2**64 == xxhash.xxh64_intdigest(b"a b c", 42)


@pytest.mark.parametrize("radius", [1, 3, 4])
def test_links_of_dense_and_spread_fingerprints(spark, radius):
    rng = random.Random(radius)
    base = rng.getrandbits(64)
    prints = {rng.getrandbits(64) for _ in range(150)}
    for _ in range(150):
        x = base
        for _ in range(rng.randint(0, 5)):
            x ^= 1 << rng.randrange(64)
        prints.add(x)
    prints = sorted(prints)
    signed = [(x - 2**64 if x >= 2**63 else x,) for x in prints]
    links = simhash.near_links(spark.createDataFrame(signed, "fp long"), radius, tree_rows=16).collect()
    assert all(((r.a ^ r.b) % 2**64).bit_count() <= radius for r in links)
    index = {x: i for i, (x,) in enumerate(signed)}
    from scriptloom.llm.bk_tree import Union

    union = Union(len(signed))
    for r in links:
        union.join(index[r.a], index[r.b])
    want = plain_components([(i, x) for i, x in enumerate(prints)], lambda a, b: (a ^ b).bit_count() <= radius)
    assert [union.find(i) for i in range(len(prints))] == want


def test_one_document_of_each_group_stays(docs, rows):
    kept = simhash.keep_one_of_each(docs)
    assert kept.columns == docs.columns
    ids = Counter(r.doc_id for r in kept.collect())
    assert ids[5] == 1 and 104 not in ids and 105 not in ids and ids[None] == 1 and sum(ids[i] for i in (100, 101, 102)) == 1


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_edit_distance():
    rng = random.Random(0)
    for _ in range(400):
        a = "".join(rng.choice("abc ") for _ in range(rng.randint(0, 25)))
        b = "".join(rng.choice("abc ") for _ in range(rng.randint(0, 25))) if rng.random() < 0.5 else a[:5] + rng.choice("abcx") + a[6:]
        d = plain_distance(a, b)
        assert line_dedup.edit_distance(a, b, 100) == d
        assert line_dedup.edit_distance(a, b, 3) == min(d, 4)
        assert line_dedup.similar(a, b, 0.8) == (d <= int(0.2 * max(len(a), len(b)) + 1e-9))
    for _ in range(300):
        a = "".join(rng.choice("abcde ") for _ in range(rng.randint(1, 250)))
        b = list(a)
        for _ in range(rng.randint(0, len(a) // 6)):
            i = rng.randrange(len(b) + 1)
            b[i : i + rng.randint(0, 1)] = rng.choice(["", "x", "yz"])
        b = "".join(b)
        assert line_dedup.similar(a, b, 0.9) == (plain_distance(a, b) <= int(0.1 * max(len(a), len(b)) + 1e-9))


def test_distances_of_many_pairs():
    rng = random.Random(2)
    pairs = []
    for _ in range(200):
        a = "".join(rng.choice("abcd e\u65e5\U0001f600") for _ in range(rng.randint(0, 60)))
        b = list(a)
        for _ in range(rng.randint(0, len(a) // 5 + 1)):
            i = rng.randrange(len(b) + 1)
            b[i : i + rng.randint(0, 1)] = rng.choice(["", "x", "yz"])
        pairs.append((a, "".join(b)))
    for most in (1, 2, 7, 130):
        got = line_dedup.distances([a for a, _ in pairs], [b for _, b in pairs], most)
        for (a, b), d in zip(pairs, got.tolist()):
            assert min(d, most + 1) == min(plain_distance(a, b), most + 1)


def plain_lines(text):
    """Normalised lines, by a rule of their own: words of ASCII letters and digits and whatever is beyond ASCII."""
    return [" ".join(re.findall(r"[a-z0-9\u0080-\U0010ffff]+", x)) for x in text.lower().split("\n")]


def plain_line_dedup(rows, similarity=0.9):
    """Lines that go, by the edit distance of all pairs of lines."""
    import struct

    places, norms = [], []
    for d, t, *_ in rows:
        h = xxhash.xxh64_intdigest((t or "").encode(), 42)
        key = struct.unpack("<q", struct.pack("<Q", h))[0]
        for i, norm in enumerate(plain_lines(t) if t else []):
            if norm:
                places.append((d, key, i))
                norms.append(norm)
    distinct = sorted(set(norms))

    def linked(a, b):
        most = int((1 - similarity) * max(len(a), len(b)) + 1e-9)
        if a == b or abs(len(a) - len(b)) > most or sum(((Counter(a) - Counter(b)) + (Counter(b) - Counter(a))).values()) > 2 * most:
            return a == b
        return plain_distance(a, b) <= most

    group = plain_components(list(enumerate(distinct)), linked)
    at = {n: i for i, n in enumerate(distinct)}
    members = defaultdict(list)
    for p, n in zip(places, norms):
        members[group[at[n]]].append(p)
    first = lambda p: (p[0] is not None, p[0] or 0, p[1], p[2])
    return {p for ps in members.values() for p in ps if p != min(ps, key=first)}


def test_lines_are_normalised():
    texts = ["", "a", "  A  b!! c \n\n ..x..\t", "\u00c9t\u00e9 \u2014 5%\r\nZ", " \n", "\u65e5\u672c\u3000x"]
    data, sizes, counts = line_dedup.normal_lines(texts)
    ends = np.cumsum(sizes)
    got = [data.tobytes()[e - n : e].decode() for e, n in zip(ends.tolist(), sizes.tolist())]
    assert got == [x for t in texts for x in plain_lines(t)] and counts.tolist() == [t.count("\n") + 1 for t in texts]


def test_lines_meet_in_hot_shards_too(spark, monkeypatch):
    """With blocks of three rows every pair of a shard still meets once, in whatever unit."""
    rng = random.Random(4)
    posts = [(i, 0, 0, 17 << 57 | (i % 3) << 30 | 1 << 25 | rng.randint(80, 120)) for i in range(60)]
    table = spark.createDataFrame(posts, "id long, fp long, sketch long, post long")
    met = minhash.meetings(table, np.full((3, 9), 64), 0.8, block_rows=3)
    size = {i: p & 0x1FFFFFF for i, _, _, p in posts}
    want = {i for i in size for j in size if i != j and i % 3 == j % 3 and min(size[i], size[j]) >= 0.8 * max(size[i], size[j])}
    assert {r.id for r in met.collect()} == want
    pairs = defaultdict(int)
    units = defaultdict(list)
    for r in minhash.units_of_work(met, 0.8, block_rows=4).collect():
        units[r.shard, r.i, r.j].append((r.id, r.block))
    for (_, i, j), rows in units.items():
        assert len(rows) <= 8
        for n, (a, x) in enumerate(rows):
            for b, y in rows[n + 1 :]:
                pairs[min(a, b), max(a, b)] += i == j or x != y
    assert all(pairs[a, b] == 1 for a in want for b in want if a < b and a % 3 == b % 3 and min(size[a], size[b]) >= 0.8 * max(size[a], size[b]))


def test_line_dedup(spark, rows, docs, empty):
    noisy = rows[:40] + [(200 + i, rows[i][1].replace("stone", "stones", 1) + "\nshort\n" + rows[i + 1][1].split("\n")[0].upper() + "!!", "en", "s0", 0) for i in range(25)] + rows[60:64]
    df = spark.createDataFrame(noisy, SCHEMA)
    gone = plain_line_dedup(noisy)
    got = {(r.doc_id, i) for r in line_dedup.line_report(df).collect() for i in r.removed_lines}
    assert got == {(d, i) for d, _, i in gone} and len(got) > 25
    kept = {r.doc_id: r.text for r in line_dedup.dedup_lines(df).collect()}
    for d, t, *_ in noisy:
        lines = [x for i, x in enumerate((t or "").split("\n")) if (d, i) not in got]
        assert kept.get(d) == (t if not t else "\n".join(lines) if lines else None)
    out = line_dedup.dedup_lines(docs)
    assert out.columns == docs.columns and 105 not in {r.doc_id for r in out.collect()}
    assert line_dedup.dedup_lines(empty).count() == 0 and line_dedup.line_report(empty).count() == 0


def test_exponent():
    tokens = {"a": 1000, "b": 100, "c": 10}
    shares = {k: v / 1110 for k, v in tokens.items()}
    for target in (0.8, 1.2, 1.5):
        a = mixing.find_exponent(tokens, target_entropy=target)
        assert abs(mixing.entropy(mixing.temper(shares, a)) - target) < 1e-9
    a = mixing.find_exponent(tokens, repetition_limit=4)
    assert abs(mixing.repetition(tokens, mixing.temper(shares, a), None) - 4) < 1e-9
    assert mixing.find_exponent(tokens, repetition_limit=1000) == 0 and mixing.find_exponent({"a": 5}, repetition_limit=2) == 1
    with pytest.raises(ValueError):
        mixing.find_exponent(tokens)


@pytest.mark.parametrize("budget", [None, 30_000])
def test_schedule_meets_budgets(spark, docs, rows, empty, budget):
    plan = mixing.schedule(docs, repetition_limit=3.0, budget_tokens=budget, block_tokens=200).collect()
    count = lambda t: len((t or "").split())
    total, longest = Counter(), Counter()
    for _, t, _, s, _ in rows:
        total[s] += count(t)
        longest[s] = max(longest[s], count(t))
    used = {k: v for k, v in total.items() if v}
    share = {k: v / sum(used.values()) for k, v in used.items()}
    weights = mixing.temper(share, mixing.find_exponent(used, repetition_limit=3.0, budget=budget))
    want = budget or 1 / min(w / used[k] for k, w in weights.items())
    read = Counter()
    for r in plan:
        read[r.source] += r.n_tokens
    for s in used:
        assert weights[s] * want - 1 <= read[s] <= weights[s] * want + longest[s] + 1
    assert max(read[s] / used[s] for s in used) <= 3.0 + max(longest[s] / used[s] for s in used)
    if budget is None:
        assert {r.doc_id for r in plan} == {d for d, *_ in rows}
        mixed = mixing.mix(docs, repetition_limit=3.0)
        assert mixed.columns == docs.columns
        assert {r.doc_id for r in mixed.collect()} == {d for d, *_ in rows}
    assert mixing.schedule(empty, repetition_limit=2.0).count() == 0 and mixing.mix(empty, repetition_limit=2.0).count() == 0


@pytest.mark.parametrize("budget", [30, 45, 50, 60, 95])
def test_mix_reads_what_is_scheduled(spark, budget):
    """With repeated rows at a budget's edge, in one block and in several."""
    rows = [(1, "a b c d e", "x"), (None, "p q", "x")] * 5 + [(i, "v w x y z", "y") for i in range(10, 20)] + [(30, None, "z"), (31, "k l", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for block in (1 << 20, 7):
        options = dict(target_entropy=1.5, budget_tokens=budget, block_tokens=block)
        want = Counter((r.doc_id, r.source) for r in mixing.schedule(docs, **options).collect())
        assert Counter((r.doc_id, r.source) for r in mixing.mix(docs, **options).collect()) == want


def test_shares_are_the_tokenizers(docs, rows):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    n = lambda t: len(library.encode(t or "", add_special_tokens=False).ids)
    plan = mixing.schedule(docs, path, repetition_limit=3.0).where("epoch = 0").collect()
    assert sorted((r.doc_id or -1, r.n_tokens) for r in plan if r.source == "s2") == sorted((d or -1, n(t)) for d, t, _, s, _ in rows if s == "s2")


def plain_schedule(rows, limit):
    """Readings of each source in tokens: shares to a power that a scan of exponents finds, all of the smallest budget spent."""
    total = Counter()
    for _, t, _, s, _ in rows:
        total[s] += len((t or "").split())
    used = {k: v for k, v in total.items() if v}
    for step in range(10_001):
        a = step / 10_000
        weight = {k: v**a for k, v in used.items()}
        rate = {k: weight[k] / used[k] for k in used}
        if max(rate.values()) / min(rate.values()) <= limit:
            return {k: rate[k] / min(rate.values()) * used[k] for k in used}


def test_schedule_against_a_scan_of_exponents(docs, rows):
    want, read, longest = plain_schedule(rows, 1.7), Counter(), Counter()
    for _, t, _, s, _ in rows:
        longest[s] = max(longest[s], 2 * len((t or "").split()))
    for r in mixing.schedule(docs, repetition_limit=1.7, block_tokens=100).collect():
        read[r.source] += r.n_tokens
    assert all(abs(read[s] - want[s]) <= longest[s] + 0.001 * want[s] for s in want)


def test_epochs_read_blocks_in_other_orders(docs):
    plan = mixing.schedule(docs, repetition_limit=3.0, block_tokens=200).where("source = 's3'").collect()
    first, second = [[r.doc_id for r in sorted((x for x in plan if x.epoch == e), key=lambda x: x.place)] for e in (0, 1)]
    assert first and second and first != second


def test_packing(spark, docs, rows, empty):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    got = packing.pack_documents(docs, path, 256).collect()
    ids = {}
    for d, t, *_ in rows:
        ids[d] = [*library.encode(t or "", add_special_tokens=False).ids, 0]
    by_seq = defaultdict(list)
    covered = Counter()
    for r in got:
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert len(part) == r.length and r.doc_tokens == len(ids[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in part))
        by_seq[r.sequence_id].append((r.offset, r.length))
        for i in range(r.start, r.start + r.length):
            covered[r.doc_id, i] += 1
    times = Counter(d for d, *_ in rows)
    assert all(covered[d, i] == times[d] for d in ids for i in range(len(ids[d]))) and sum(covered.values()) == sum(len(ids[d]) * k for d, k in times.items())
    for pieces in by_seq.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 256
    assert sorted(by_seq) == list(range(len(by_seq)))
    assert packing.pack_documents(empty, path).count() == 0


def test_relaxation_is_near_its_bound():
    rng = random.Random(4)
    demand = {x: rng.randint(1, 400) for x in rng.sample(range(1, 65), 40)}
    material = sum(x * n for x, n in demand.items()) / 64
    plan = packing.round_patterns(packing.solve_relaxation(demand, 64), demand, 64)
    used = Counter()
    for pattern, n in plan:
        assert sum(x * k for x, k in pattern) <= 64
        for x, k in pattern:
            used[x] += k * n
    assert used == Counter(demand)
    relaxed = sum(v for _, v in packing.solve_relaxation(demand, 64))
    assert material <= relaxed + 1e-6 and sum(n for _, n in plan) <= 1.01 * relaxed + 2


def test_shards(spark, docs, rows, empty):
    got = sharding.shard_documents(docs, shards=16).collect()
    want = Counter((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t, *_ in rows)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == want
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values()) and set(slots) <= set(range(16))
    assert sharding.shard_documents(empty).count() == 0


def test_shards_are_near_equal_and_keep_copies(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice("abc\né") for _ in range(rng.randint(1, 60))) for _ in range(400)]
    rows = [(i, texts[i % 400] if i < 2000 else "the same text everywhere") for i in range(3000)]
    got = sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string"), shards=7).collect()
    size, where = Counter(), defaultdict(set)
    for r in got:
        size[r.shard] += r["size"]
        where[r.text_crc32].add(r.shard)
    target = sum(size.values()) / 7
    assert len(size) == 7 and all(abs(v - target) < 0.04 * target for v in size.values())
    assert sum(len(s) > 1 for s in where.values()) <= 7
    by_target = sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string"), target_bytes=int(target) + 1)
    assert by_target.agg(F.max("shard")).first()[0] == 6
