"""The scored-outcomes view of the synthetic tables, for Spark and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table

SCORED_SQL = """
o AS (
  SELECT d.doc_id AS row_id, d.source AS script, d.lang AS question,
         ((d.doc_id * 37) % 101) / 100.0::DOUBLE AS score,
         greatest(((d.doc_id * 37) % 101) / 100.0::DOUBLE, 1.0::DOUBLE - ((d.doc_id * 37) % 101) / 100.0::DOUBLE) AS confidence,
         CASE WHEN ((d.doc_id * 37) % 101) >= 50 THEN 'true' ELSE 'false' END AS predicted,
         l.quality = 1 AS gold_bool, CASE WHEN l.quality = 1 THEN 'true' WHEN l.quality IS NOT NULL THEN 'false' END AS gold,
         l.quality IS NOT NULL AS gradable,
         coalesce((((d.doc_id * 37) % 101) >= 50) = (l.quality = 1), FALSE) AS agree
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
)
"""


def scored_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """row_id, script, question, score, confidence, predicted, gold, gold_bool, gradable, agree of each document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    points = (F.col("doc_id") * 37) % 101
    score = points / F.lit(100.0)
    gold = F.col("quality") == 1
    yes = points >= 50
    return docs.join(labels, "doc_id", "left").select(
        F.col("doc_id").alias("row_id"), F.col("source").alias("script"), F.col("lang").alias("question"), score.alias("score"),
        F.greatest(score, F.lit(1.0) - score).alias("confidence"), F.when(yes, "true").otherwise("false").alias("predicted"), gold.alias("gold_bool"),
        F.when(gold, "true").when(F.col("quality").isNotNull(), "false").alias("gold"), F.col("quality").isNotNull().alias("gradable"),
        F.coalesce(yes == gold, F.lit(False)).alias("agree"),
    )


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, for results that sums in another order may change in the last digits."""
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])
