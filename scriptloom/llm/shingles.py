"""Near-duplicates by the Jaccard similarity of word shingles: SimHash shards searched by BK-trees, MinHash marks for
pairs whose fingerprints are further apart, exact verification, components."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.workspace import write_table
from .components import connected_components
from .line_dedup import may_hold
from .minhash import SIZE_BITS, id_of, marks, met_units, mixed, posts_of, sketches, verified_links
from .simhash import majority, near_pairs, one_of_each

#: Columns of marks; documents are compared if they share two of the first seven: a pair of
#: similarity 0.8 doesn't once in 2,700.  Nothing is known of their bits.
ORDERS, REACH = 8, np.array([[-1, -1, *[64] * 7]])
#: Bits that fingerprints met by BK-trees differ in at most, and the pigeonhole blocks that they agree in one of.
RADIUS, BLOCKS = 3, 4


def text_words(text: str | None) -> list[bytes]:
    """Runs without ASCII white space, A-Z in lower case."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def shingle_hashes(words: list[bytes], width: int) -> np.ndarray:
    """XXH64 of the distinct runs of ``width`` words; fewer words make one."""
    return np.unique(run_hashes(words, width))


def run_hashes(words: list[bytes], width: int) -> np.ndarray:
    """XXH64 of the runs of ``width`` words, repeats included; fewer words make one."""
    import xxhash

    runs = [b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))] if words else []
    return np.fromiter(map(xxhash.xxh64_intdigest, runs), np.uint64, len(runs))


def jaccard_tests(width: int, similarity: float) -> Callable:
    """Tests of a part's pairs of texts, as ``verified_links`` wants them; sets are kept while there is room."""

    def prepare(bodies: np.ndarray, sizes: np.ndarray) -> tuple[Callable, Callable]:
        known: dict[int, set] = {}

        def of(i: int) -> set:
            if i not in known:
                if len(known) > 1000:
                    known.clear()
                known[i] = set(shingle_hashes(text_words(bodies[i]), width).tolist())
            return known[i]

        def alike(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            out = np.zeros(len(a), bool)
            for k, (u, v) in enumerate(zip(a.tolist(), b.tolist())):
                x, y = of(u), of(v)
                both = len(x & y)
                out[k] = both >= similarity * (len(x) + len(y) - both) - 1e-9
            return out

        return lambda a, b: np.ones(len(a), bool), alike

    return prepare


def shard_posts(fp: int, size: int) -> list[int]:
    """A post (as ``posts_of`` makes them) for each block of the fingerprint's bits."""
    blocks = ((fp >> 16 * k & 0xFFFF for k in range(BLOCKS)))
    return [k << 32 + SIZE_BITS | block << SIZE_BITS | min(size, (1 << SIZE_BITS) - 1) for k, block in enumerate(blocks)]


def near_in_trees(part: dict[str, np.ndarray], units: tuple[str, ...], reach: np.ndarray, ratio: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows (a < b) of one unit whose fingerprints BK-trees find within ``RADIUS`` bits, with sizes at least as ``ratio`` to 1; pairs may repeat.

    Where two blocks of a shard meet, the rows of one are the trees that those of the other ask.
    """
    n, size = len(part["size"]), part["size"]
    if not n:
        return
    change = np.zeros(n, bool)
    for c in units:
        change[1:] |= part[c][1:] != part[c][:-1]
    in_tree = asks = np.ones(n, bool)
    if "j" in part:
        in_tree, asks = part["block"] == part["i"], part["block"] == part["j"]
    fp = part["fp"].astype(np.int64).view(np.uint64)
    for q, t in near_pairs(fp, np.cumsum(change), (part["shard"] >> 32) << 40, in_tree, asks, RADIUS):
        a, b = np.minimum(q, t), np.maximum(q, t)
        fits = (a < b) & (np.minimum(size[a], size[b]) >= ratio * np.maximum(size[a], size[b]) - 1e-6)
        yield a[fits], b[fits]


def marked(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, text_key, key (of the text's words), posts (of marks), shards (posts of the fingerprint), sketch, fp of each row
    of ``docs``; a text without words has no posts."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, posts, shards, drawn, fps = [], [], [], [], []
            for text in batch.column("text").to_pylist():
                words = text_words(text)
                every = run_hashes(words, width)
                found = np.unique(every)
                keys.append(hashlib.md5(b" ".join(words), usedforsecurity=False).digest())
                made = marks(mixed(found), np.zeros(1, np.int64), ORDERS) if len(found) else np.zeros((1, 0), np.uint64)
                posts.append(posts_of(made, np.array([len(found)]))[0])
                drawn.append(int(sketches(made)[0]))
                fps.append(majority(every))
                shards.append(shard_posts(fps[-1], len(found)) if words else [])
            lists = [pa.array(x, pa.list_(pa.int64())) for x in (posts, shards)]
            arrays = [batch.column("doc_id"), batch.column("text_key"), pa.array(keys, pa.binary()), *lists, pa.array(drawn, pa.int64()), pa.array(np.array(fps, np.uint64).view(np.int64))]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "text_key", "key", "posts", "shards", "sketch", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    slim = docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    return slim.mapInArrow(compute, f"doc_id {kind}, text_key long, key binary, posts array<long>, shards array<long>, sketch long, fp long")


def keep_one_of_alike(docs: DataFrame, width: int = 5, similarity: float = 0.8) -> DataFrame:
    """``docs`` (doc_id, text and any other columns): of each group of near-duplicates the document with the smallest doc_id.

    Documents are linked if the sets of their ``width``-word shingles have a Jaccard similarity of ``similarity`` at
    least.  Pairs are found by their SimHashes (shards of agreeing blocks of bits, BK-trees within ``RADIUS`` bits) and,
    as many such pairs are further apart, by MinHash; each is verified, and groups are what links join.  Null and
    blank texts are one group.  Of rows that repeat the doc_id that stays one stays.  Rows with a null doc_id are kept
    as they are.
    """
    rows = write_table(marked(docs, width), "marked")
    one = [F.first(c).alias(c) for c in ("posts", "shards", "sketch", "fp")]
    classes = rows.groupBy("key").agg(F.min(F.struct("doc_id", "text_key")).alias("first"), F.min("doc_id").alias("least"), *one)
    classes = write_table(classes.withColumn("id", id_of("key")), "doc-classes")
    posted = lambda c: classes.select("id", "fp", "sketch", F.explode(c).alias("post"))
    by_tree = met_units(posted("shards"), REACH, similarity, near_in_trees)
    by_mark = met_units(posted("posts"), REACH, similarity)
    met = by_tree.select(F.col("id").alias("_id")).union(by_mark.select("id")).distinct()
    wanted = classes.join(met, F.col("id") == F.col("_id")).select("id", "first", F.col("first.text_key").alias("_key"), "key")
    wanted = write_table(wanted, "active-documents")
    texts = may_hold(docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text"), "text_key", wanted)
    on = (texts["text_key"] == wanted["_key"]) & texts["doc_id"].eqNullSafe(wanted["first.doc_id"])
    bodies = write_table(texts.join(wanted, on).select("id", "key", F.col("text").alias("body")), "bodies")
    tests = jaccard_tests(width, similarity)
    links = verified_links(by_tree, bodies, tests, REACH, similarity, near_in_trees).union(verified_links(by_mark, bodies, tests, REACH, similarity))
    reached = connected_components(links)
    grouped = write_table(classes.join(reached, classes["key"] == reached["node"], "left").select("least", F.coalesce("component", "key").alias("component")), "doc-groups")
    return one_of_each(docs, grouped.groupBy("component").agg(F.min("least").alias("doc_id")).where("doc_id IS NOT NULL").select("doc_id").distinct())
