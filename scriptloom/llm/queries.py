"""Queries over the synthetic tables, one for each operator, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@_query
def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings of all documents by temperature, with no source read more than four times."""
    from .mixing import schedule

    plan = schedule(spark.read.parquet(f"{sf_dir}/documents.parquet"), _tokenizer("byte_bpe_50k.json"), repetition_limit=4.0)
    return plan.select("doc_id", "source", "n_tokens", "epoch", "place")


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@_query
def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents by the compiled word BPE."""
    from .token_counts import token_counts

    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), _tokenizer("word_bpe_49k.json"))


@_query
def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of all documents, learned from those not held out."""
    from .language_id import identify

    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet"))


@_query
def op4_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every row for each row whose id is divisible by 20."""
    from .permutation_index import nearest_neighbours

    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest_neighbours(vectors, F.col("vec_id") % 20 == 0, k=20)


@_query
def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents whose fingerprints differ in at most 3 bits."""
    from .simhash import simhash_components

    found = simhash_components(spark.read.parquet(f"{sf_dir}/documents.parquet"), width=3, radius=3)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@_query
def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that each document loses to equal or similar ones."""
    from .line_dedup import line_report

    return line_report(spark.read.parquet(f"{sf_dir}/documents.parquet"))


@_query
def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 1024 ids."""
    from .packing import pack_documents

    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), _tokenizer("byte_bpe_50k.json"), 1024)


@_query
def op8_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards of near equal bytes."""
    from .sharding import shard_documents

    placed = shard_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), shards=16)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@_query
def op9_epsilon_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all embeddings with a cosine of at least 0.9."""
    from .epsilon_join import cosine_components

    return cosine_components(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), threshold=0.9)


ORACLES["op9_epsilon_join"] = """
WITH RECURSIVE e AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
), ok AS (
  SELECT vec_id, v, sqrt(list_inner_product(v, v)) AS n FROM e
  WHERE v IS NOT NULL AND len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND list_inner_product(v, v) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.vec_id <> b.vec_id
  WHERE list_inner_product(a.v, b.v) / (a.n * b.n) >= 0.9
), reach AS (
  SELECT vec_id AS a, vec_id AS b FROM e UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
)
SELECT e.vec_id AS vec_id, (SELECT count(*) FROM links WHERE links.a = e.vec_id) AS n_links,
       (SELECT min(b) FROM reach WHERE reach.a = e.vec_id) AS component_id,
       e.vec_id = (SELECT min(b) FROM reach WHERE reach.a = e.vec_id) AS kept
FROM e
"""


@_query
def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written to WARC archives and read back by the index."""
    from .warc import archive_pages

    return archive_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))


ORACLES["op10_warc"] = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS d FROM pages
), o AS (SELECT d, max(page_id) AS owner FROM p WHERE n >= 1000 GROUP BY d)
SELECT p.page_id AS page_id, CAST(p.n AS BIGINT) AS payload_bytes, p.d AS payload_digest,
       CASE WHEN o.owner <> p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN o.owner <> p.page_id THEN o.owner END AS refers_to
FROM p LEFT JOIN o ON p.d = o.d AND p.n >= 1000
"""


@_query
def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each of five filters removes from all documents, in every order, by source."""
    from .filter_audit import audit

    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


ORACLES["op11_filter_audit"] = r"""
WITH d AS (
  SELECT doc_id, coalesce(CAST(source AS VARCHAR), '') AS part, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), f AS (
  SELECT doc_id, part,
         CASE WHEN len(w) < 200 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 2 ELSE 0 END
         + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) THEN 4 ELSE 0 END
         + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
         + CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 16 ELSE 0 END AS mask
  FROM d
), m AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS bad
  FROM labels GROUP BY doc_id
), c AS (
  SELECT part, mask, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(bad), 0) AS bad
  FROM f LEFT JOIN m USING (doc_id) GROUP BY part, mask
), l AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x, unnest([1, 2, 4, 8, 16]) AS b
), o AS (
  SELECT p.x || q.x || r.x || s.x || t.x AS filter_order, [p.b, q.b, r.b, s.b, t.b] AS bits
  FROM l p, l q, l r, l s, l t
  WHERE p.b + q.b + r.b + s.b + t.b = 31 AND (p.b | q.b | r.b | s.b | t.b) = 31
), e AS (
  SELECT filter_order, bits, CAST(unnest(range(1, 6)) AS INTEGER) AS step FROM o
), k AS (
  SELECT filter_order, step, bits[step] AS bit, coalesce(CAST(list_sum(bits[1:step - 1]) AS INTEGER), 0) AS earlier FROM e
)
SELECT part, filter_order, step, substr(filter_order, step, 1) AS filter,
       CAST(sum(CASE WHEN mask & (bit | earlier) = 0 THEN n ELSE 0 END) AS BIGINT) AS kept,
       CAST(sum(CASE WHEN mask & bit <> 0 AND mask & earlier = 0 THEN n ELSE 0 END) AS BIGINT) AS removed,
       CAST(sum(CASE WHEN mask & bit <> 0 AND mask & earlier <> 0 THEN n ELSE 0 END) AS BIGINT) AS redundant,
       CAST(sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
       CAST(sum(CASE WHEN mask & bit <> 0 AND mask & earlier = 0 THEN good ELSE 0 END) AS BIGINT) AS good_lost,
       CAST(sum(CASE WHEN mask & bit <> 0 AND mask & earlier = 0 THEN bad ELSE 0 END) AS BIGINT) AS toxic_lost,
       CAST(sum(CASE WHEN mask & bit <> 0 THEN n * 120 // bit_count(mask) ELSE 0 END) AS BIGINT) AS shapley
FROM c, k GROUP BY part, filter_order, step, bit, earlier
"""


@_query
def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of all documents, also below layers of encoding."""
    from .secret_scan import scan_documents

    return scan_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))


@_query
def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2,000 strongest phrases of each language of all documents."""
    from .collocations import collocations

    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLES["op13_collocations"] = r"""
WITH p AS (
  SELECT coalesce(CAST(lang AS VARCHAR), 'und') AS lang,
         unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), w AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p
), i AS (
  SELECT lang, ws, CAST(unnest(range(1, len(ws) + 1)) AS INTEGER) AS s FROM w
), g AS (
  SELECT lang, k, array_to_string(ws[s:s + k - 1], ' ') AS phrase, count(*) AS n
  FROM i, (SELECT CAST(unnest(range(1, 6)) AS INTEGER) AS k) WHERE s + k - 1 <= len(ws)
  GROUP BY lang, k, phrase
), f AS (
  SELECT lang, k, phrase, n FROM g WHERE n >= 100
), t AS (
  SELECT lang, sum(n) AS n FROM g WHERE k = 1 GROUP BY lang
), c AS (
  SELECT * FROM f AS s WHERE k >= 2 AND NOT EXISTS (
    SELECT 1 FROM f AS x WHERE x.lang = s.lang AND x.k > s.k AND 100 * x.n >= 100 * s.n
      AND contains(' ' || x.phrase || ' ', ' ' || s.phrase || ' '))
), h AS (
  SELECT lang, phrase, k, n AS a, string_split(phrase, ' ') AS ws, CAST(unnest(range(1, k)) AS INTEGER) AS cut FROM c
), x AS (
  SELECT h.lang, h.phrase, h.a, h.cut, l.n AS l, r.n AS r, t.n AS n,
         (CAST(1000 AS HUGEINT) * h.a * t.n) // (CAST(l.n AS HUGEINT) * r.n) AS score
  FROM h JOIN f l ON l.lang = h.lang AND l.phrase = array_to_string(h.ws[1:cut], ' ')
         JOIN f r ON r.lang = h.lang AND r.phrase = array_to_string(h.ws[cut + 1:], ' ')
         JOIN t ON t.lang = h.lang
), y AS (
  SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) AS first FROM x
), z AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM y WHERE first = 1
)
SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r,
       CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM z WHERE rank <= 2000
"""
