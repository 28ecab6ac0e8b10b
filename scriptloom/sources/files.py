"""Sources and sinks of the analytics: scripts, census CSV, runs, decisions, judgements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .schemas import JUDGEMENT, PREDICTION


def scripts(spark: SparkSession, path: str) -> DataFrame:
    """name, sql of the ``.sql`` files below a folder, one row each."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.sql").text(path, wholetext=True)
    return files.select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.sql$", 1).alias("name"), F.col("value").alias("sql"))


def natural_key(name: str) -> Column:
    """Order in which query2 comes before query10."""
    return F.struct(F.coalesce(F.regexp_replace(name, r"\D", "").try_cast("long"), F.lit(0)), F.col(name))


def flatten(df: DataFrame) -> DataFrame:
    """Arrays as text joined by ``|``, structs as their fields: what a CSV file can hold."""
    columns: list[Column] = []
    for c, kind in df.dtypes:
        if kind.startswith("struct"):
            columns += [F.col(f"{c}.{f.name}").alias(f"{c}_{f.name}") for f in df.schema[c].dataType.fields]
        else:
            columns.append(F.concat_ws("|", c).alias(c) if kind == "array<string>" else F.to_json(c).alias(c) if kind.startswith(("array", "map")) else F.col(c))
    return df.select(*columns)


def write_census(df: DataFrame, path: str) -> None:
    flatten(df).write.mode("overwrite").option("header", "true").csv(path)


def split_list(c: Column) -> Column:
    """A list that was joined by ``|``; a single element stays a list, empty ones go."""
    return F.filter(F.split(F.coalesce(c, F.lit("")), r"\|"), lambda x: x != "")


def read_census(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """A census written before, with the columns and types of ``like``: text is read and cast, what is no number is null."""
    text = spark.read.option("header", "true").schema(", ".join(f"`{c}` string" for c, _ in flatten(like).dtypes)).csv(path)
    back = [split_list(F.col(c)).alias(c) if t == "array<string>" else F.col(c).try_cast(t).alias(c) for c, t in like.dtypes if not t.startswith(("struct", "map"))]
    return text.select(*back)


def read_run(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Long answers of a run, one row for each (script, question): from files of one JSON document a script, or of JSON ``lines``."""
    docs = spark.read.schema(PREDICTION).option("multiLine", str(not lines).lower()).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").json(path)
    long = docs.select("script_id", "origin", "elapsed_ms", "input_tokens", F.explode("answers").alias("question", "a"))
    return long.select(F.coalesce("origin", "script_id").alias("script"), "script_id", "origin", "question", "a.*", "elapsed_ms", "input_tokens")


def write_run(answers: DataFrame, path: str, run_id: str) -> None:
    """Answers as JSON lines of one script each, below ``run_id=...``; ``read_run`` with ``lines`` is the inverse."""
    fields = ["type", "value_num", "value_str", "label", "max_probability", "reported_confidence", "probabilities"]
    body = F.struct(*[(F.col(c) if c in answers.columns else F.lit(None)).alias(c) for c in fields])
    docs = answers.groupBy("script_id", "origin").agg(
        F.map_from_entries(F.collect_list(F.struct("question", body))).alias("answers"), F.max("input_tokens").alias("input_tokens"), F.max("elapsed_ms").alias("elapsed_ms"),
        (F.max("elapsed_ms") / F.count(F.lit(1))).alias("ms_per_question"),
    )
    docs.withColumn("run_id", F.lit(run_id)).write.mode("overwrite").partitionBy("run_id").json(path)


def write_decisions(outcomes: DataFrame, decisions: DataFrame, path: str) -> None:
    """One CSV row for each question, with its script's outcome."""
    rows = outcomes.join(decisions.select("script", "outcome"), "script")
    rows.select("script", "outcome", "question", "gold", "predicted", "agree", "confidence", "confidence_band").write.mode("overwrite").option("header", "true").csv(path)


def read_judgements(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(JUDGEMENT).json(path)


def script_documents(census: DataFrame, judgements: DataFrame | None = None) -> DataFrame:
    """Scripts with gold labels: three follow from counts, strategy and review from judgements by origin (null without)."""
    gold = census.select(
        "*", F.col("name").alias("origin"), (F.col("subquery_count") > 0).alias("has_subquery"), (F.col("window_function_count") > 0).alias("has_window_function"),
        (F.col("source_tables") >= 4).alias("multi_source"), F.col("band").alias("migration_complexity"),
    )
    if judgements is None:
        return gold.withColumn("purpose", F.lit("")).withColumn("rewrite_strategy", F.lit(None).cast("string")).withColumn("needs_human_review", F.lit(None).cast("boolean"))
    return gold.join(judgements.select("origin", "purpose", "rewrite_strategy", "needs_human_review"), "origin", "left")


def gold_long(documents: DataFrame) -> DataFrame:
    """script, question, gold (text) of the labels that documents have."""
    flags = ("has_subquery", "has_window_function", "multi_source", "needs_human_review")
    pairs = [F.struct(F.lit(q).alias("question"), F.col(q).cast("string").alias("gold")) for q in (*flags, "migration_complexity", "rewrite_strategy")]
    return documents.select(F.col("origin").alias("script"), F.explode(F.array(*pairs)).alias("x")).select("script", "x.*").where("gold IS NOT NULL")
