"""Documents to packed training sequences: language, lines, near-duplicates, mixture, packing.

Every stage but the last returns the columns of its input, whatever they are called (doc_id, text, lang and source
among them), and an empty table for an empty one.  A stage's own tables are deleted when the next stage begins.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from scriptloom.functions.workspace import Tables, delete, shared_root
from scriptloom.llm import language_id, line_dedup, mixing, packing, shingles

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Tables of a stage that is called by itself: its result is saved before the next stage is called.
_OF_STAGE = Tables()


def _stage(f: Stage) -> Stage:
    @functools.wraps(f)
    def called(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        _OF_STAGE.release(spark)
        with _OF_STAGE:
            return f(spark, docs, sf_dir)

    called.work = f
    return called


@_stage
def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that language identification rejects: those without letters (null and empty texts
    among them) and those that resemble no learned language.  Each row is judged by itself, so repeated rows and rows
    with a null doc_id or lang stay or go alike; ties between languages reject nothing."""
    return language_id.keep_identified(docs)


@_stage
def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without lines that repeat others, exactly or nearly: of each group the occurrence with the smallest (doc_id, hash of
    the text, line) stays, a null doc_id first.  A document that loses all its lines goes; null and empty texts stay.
    Rows that repeat doc_id and text lose the same lines."""
    return line_dedup.dedup_lines(docs)


@_stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word Jaccard similarity of 0.8 at least): the smallest doc_id,
    one of the rows that repeat it.  Null and blank texts are one group; rows with a null doc_id all stay."""
    return shingles.keep_one_of_alike(docs, width=5, similarity=0.8)


@_stage
def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at tempered weights: each row at least once, no source more than twice (but for a document at the
    budget's edge).  A null source is a source; null and empty texts have no tokens and are read with their block;
    rows that repeat doc_id and text are read one by one."""
    return mixing.mix(docs, tokenizer=public_tokenizers.path("byte_bpe_50k.json"), repetition_limit=2.0)


@_stage
def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 1024 ids; a null or empty text is its closing id, each repeated row is packed
    for itself, and rows with a null doc_id are packed like others."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), 1024)


STAGES = [("language", language), ("lines", lines), ("near_duplicates", near_duplicates), ("mixture", mixture), ("sequences", sequences)]

#: Fingerprints, hyperdimensional vectors and tokenizers are beyond SQL; the pipeline is tested against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; each stage's are written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    saved = None
    for name, stage in STAGES[:-1]:
        path = f"{shared_root(spark)}/stage-{name}-{uuid.uuid4().hex}"
        with Tables() as own:
            made = stage.work(spark, docs, sf_dir)
            made.write.parquet(path)
        own.release(spark)
        docs = spark.read.schema(made.schema).parquet(path)
        if saved:
            delete(spark, saved)
        saved = path
    return STAGES[-1][1].work(spark, docs, sf_dir)
