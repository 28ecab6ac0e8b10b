"""Language identification by hyperdimensional profiles.

Each character has a random vector of signs, drawn from its code point.  A
letter trigram abc is bound as the product of a's vector rotated twice, b's
rotated once and c's.  Trigram vectors of a text are bundled by adding; so are
the bundles of a language's texts, into its prototype.  A text is compared with
the prototypes by cosine.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNDETERMINED = "und"
_SPACE = 0x20
#: Trigrams bundled at a time.
_STEP = 4096


def _letters() -> np.ndarray:
    """For each code point its folded form: the letter in lower case, or a space for what is no letter."""
    table = np.full(0x110000, _SPACE, np.uint32)
    for cp in range(0x110000):
        c = chr(cp)
        if c.isalpha():
            low = c.lower()
            table[cp] = ord(low) if len(low) == 1 else cp
    return table


_TABLE: list[np.ndarray] = []


def letter_codes(text: str) -> np.ndarray:
    """Code points of a text in lower case between spaces, with each run of non-letters as one space; empty if no letters."""
    if not _TABLE:
        _TABLE.append(_letters())
    codes = _TABLE[0][np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    space = codes == _SPACE
    if space.all():
        return codes[:0]
    keep = ~space
    keep[1:] |= space[1:] & ~space[:-1]  # the first of a run of non-letters
    if len(keep):
        keep[0] = True
    codes = codes[keep]
    pad = np.array([_SPACE], np.uint32)
    return np.concatenate([pad[: int(codes[0] != _SPACE)], codes, pad[: int(codes[-1] != _SPACE)]])


class HyperVectors:
    """Random sign vectors of characters and what is bound from them; any process draws the same."""

    def __init__(self, dimension: int, seed: int):
        self.dimension, self.seed = dimension, seed
        self._vectors: dict[int, np.ndarray] = {}

    def letter(self, code: int) -> np.ndarray:
        if (v := self._vectors.get(code)) is None:
            if len(self._vectors) > 50_000:
                self._vectors.clear()
            signs = np.random.Generator(np.random.Philox(key=[self.seed, code])).integers(0, 2, self.dimension, np.int8)
            v = self._vectors[code] = signs * 2 - 1
        return v

    def trigrams(self, a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
        """Bound vectors (rows) of trigrams of code points."""
        codes, place = np.unique(np.concatenate([a, b, c]), return_inverse=True)
        vectors = np.stack([self.letter(int(x)) for x in codes])
        n = len(a)
        return np.roll(vectors, 2, 1)[place[:n]] * np.roll(vectors, 1, 1)[place[n : 2 * n]] * vectors[place[2 * n :]]

    def bundle(self, texts: list[str | None]) -> np.ndarray:
        """One row for each text: the sum of its trigrams' vectors (zero if it has no letters)."""
        out = np.zeros((len(texts), self.dimension), np.float32)
        keys, owner = [], []
        for i, t in enumerate(texts):
            codes = letter_codes(t) if t else ()
            if len(codes) >= 3:
                x = codes.astype(np.uint64)
                # 21 bits hold any code point.
                k, n = np.unique(x[:-2] << np.uint64(42) | x[1:-1] << np.uint64(21) | x[2:], return_counts=True)
                keys.append(k)
                owner.append((i, n))
        if not keys:
            return out
        flat = np.concatenate(keys)
        trigrams, place = np.unique(flat, return_inverse=True)
        sizes = np.array([len(k) for k in keys])
        rows = np.repeat(np.array([i for i, _ in owner]), sizes)
        counts = np.concatenate([n for _, n in owner]).astype(np.float32)
        used = np.array([i for i, _ in owner])
        row_at = np.zeros(len(texts), np.int64)
        row_at[used] = np.arange(len(used))
        dense_rows = row_at[rows]
        mask = np.uint64((1 << 21) - 1)
        order = np.argsort(place, kind="stable")
        place, dense_rows, counts = place[order], dense_rows[order], counts[order]
        total = np.zeros((len(used), self.dimension), np.float32)
        for s in range(0, len(trigrams), _STEP):
            t = trigrams[s : s + _STEP]
            lo, hi = np.searchsorted(place, [s, s + len(t)])
            weights = np.zeros((len(used), len(t)), np.float32)
            weights[dense_rows[lo:hi], place[lo:hi] - s] = counts[lo:hi]
            bound = self.trigrams(t >> np.uint64(42), t >> np.uint64(21) & mask, t & mask)
            total += weights @ bound.astype(np.float32)
        out[used] = total
        return out


def _blocks(texts: list, rows: int = 256) -> Iterator[tuple[int, list]]:
    for i in range(0, len(texts), rows):
        yield i, texts[i : i + rows]


def train(labelled: DataFrame, dimension: int = 1024, seed: int = 7) -> dict[str, np.ndarray]:
    """Prototypes by language from ``labelled`` (text, lang); all of its rows count.

    Each text adds its bundle, scaled to length 1 so that long texts don't drown
    others.  Rows without language, text or letters add nothing.  A task sends one
    partial bundle for each language it has met; they are added by Spark, and one
    vector for each language comes to the driver.
    """

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, sums = HyperVectors(dimension, seed), {}
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            for i, texts in _blocks(batch.column("text").to_pylist()):
                bundles = vectors.bundle(texts)
                norms = np.sqrt(np.einsum("ij,ij->i", bundles, bundles, dtype=np.float64))
                of = langs[i : i + len(texts)]
                for lang in set(of) - {None}:
                    rows = [j for j, x in enumerate(of) if x == lang and norms[j]]
                    if rows:
                        sums[lang] = sums.get(lang, 0) + (bundles[rows] / norms[rows, None]).sum(0, dtype=np.float64)
        for lang, v in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([np.rint(v * (1 << 20)).astype(np.int64)], pa.list_(pa.int64()))], names=["lang", "v"])

    # Sums of integers don't depend on the order in which tasks end.
    parts = labelled.where("lang IS NOT NULL AND text IS NOT NULL").select("text", "lang").mapInArrow(partial, "lang string, v array<long>")
    summed = parts.select("lang", F.posexplode("v").alias("d", "x")).groupBy("lang", "d").agg(F.sum("x").alias("x"))
    rows = summed.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("d", "x"))).alias("v")).select("lang", "v.x").collect()
    found = {}
    for r in sorted(rows, key=lambda r: r["lang"]):
        v = np.array(r["x"], np.float64)
        if n := np.linalg.norm(v):
            found[r["lang"]] = v / n
    return found


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray], dimension: int = 1024, seed: int = 7, drop_text: bool = False) -> DataFrame:
    """``docs`` (text and any other columns) with lang_pred and score added; without its text on demand.

    The nearest prototype's language and its cosine, kept in 0..1; ties go to the
    first language by name.  ``und`` and 0 for a text that is null or has no letters,
    and for any text if there are no prototypes.
    """
    langs = list(prototypes)
    matrix = np.stack([prototypes[x] for x in langs]).astype(np.float32) if langs else None

    def guess(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors = HyperVectors(dimension, seed)
        for batch in batches:
            names, scores = [], []
            for _, texts in _blocks(batch.column("text").to_pylist()):
                bundles = vectors.bundle(texts)
                norms = np.sqrt(np.einsum("ij,ij->i", bundles, bundles, dtype=np.float64))
                if matrix is None:
                    names += [UNDETERMINED] * len(texts)
                    scores += [0.0] * len(texts)
                    continue
                cosine = (bundles @ matrix.T) / np.where(norms == 0, 1, norms)[:, None]
                best = cosine.argmax(1)
                has = [n > 0 or bool(t) and any(c.isalpha() for c in t) for n, t in zip(norms, texts)]
                names += [langs[b] if h else UNDETERMINED for b, h in zip(best, has)]
                scores += [float(min(1.0, max(0.0, cosine[j, b]))) if h else 0.0 for j, (b, h) in enumerate(zip(best, has))]
            kept = [c for c in batch.schema.names if not (drop_text and c == "text")]
            yield pa.RecordBatch.from_arrays([*map(batch.column, kept), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[*kept, "lang_pred", "score"])

    from pyspark.sql.types import DoubleType, StringType, StructField, StructType

    fields = [f for f in docs.schema.fields if not (drop_text and f.name == "text")]
    schema = StructType([*fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    return docs.mapInArrow(guess, schema)


def held_out(doc_id: Column) -> Column:
    """The fourth of the documents that is never learned from: crc32 of the id's digits leaves 2 by 4."""
    return F.coalesce(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, dimension: int = 1024, seed: int = 7) -> DataFrame:
    """doc_id, held_out, lang_pred, score of each row of ``docs`` (doc_id, text, lang), learned from those not held out."""
    slim = docs.select("doc_id", "text", "lang").withColumn("held_out", held_out(F.col("doc_id")))
    prototypes = train(slim.where("NOT held_out"), dimension, seed)
    return predict(slim.select("doc_id", "held_out", "text"), prototypes, dimension, seed, drop_text=True)


def keep_identified(docs: DataFrame, min_score: float = 0.2, min_chars: int = 400, dimension: int = 1024, seed: int = 7) -> DataFrame:
    """``docs`` (doc_id, text, lang and any other columns) without those of no language.

    Rejected are texts that are null or have no letters, and texts of at least
    ``min_chars`` characters whose score is under ``min_score``: they resemble no learned
    language.  (The score of a short text says little.)  If nothing can be learned, only
    the former go.
    """
    prototypes = train(docs.where(~held_out(F.col("doc_id"))), dimension, seed)
    own = docs.select(*[F.col(c).alias(f"_{i}") for i, c in enumerate(docs.columns)], F.col("text"))
    found = predict(own.drop(f"_{docs.columns.index('text')}"), prototypes, dimension, seed)
    few = (F.length("text") >= min_chars) & (F.col("score") < min_score) if prototypes else F.lit(False)
    found = found.where(F.col("text").isNotNull() & F.col("text").rlike(r"\p{L}") & ~few)
    return found.select(*[F.col("text") if c == "text" else F.col(f"_{i}").alias(c) for i, c in enumerate(docs.columns)])
