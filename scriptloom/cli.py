"""Commands over files: each reads, builds a plan, and writes its result or shows it."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import cards, comparison, decisions, labels, metrics, regression, sampling, script_features, training
from .plans.scripts import BANDS, census
from .session import local_session
from .sources import files

BOOLEAN = ("has_subquery", "has_window_function", "multi_source", "needs_human_review")
BAND_RANGES = {name: (lo, hi) for name, lo, hi in BANDS}

#: Wordings of one question at most: each is a column of the ensemble.
MAX_WORDINGS = 100


def graded(spark: SparkSession, args: argparse.Namespace, run: str | None = None) -> tuple[DataFrame, DataFrame]:
    """A run's answers and the gold of the scripts below ``--scripts``."""
    judged = files.read_judgements(spark, args.judgements) if args.judgements else None
    docs = files.script_documents(census(files.scripts(spark, args.scripts)), judged)
    return files.read_run(spark, run or args.run), files.gold_long(docs)


def binary(answers: DataFrame, gold: DataFrame) -> DataFrame:
    """question, origin, score, gold_bool of yes/no questions."""
    yes = gold.where(F.col("question").isin(*BOOLEAN)).select("script", "question", (F.col("gold") == "true").alias("gold_bool"))
    return answers.where("type = 'noul'").select("script", "question", F.col("value_num").alias("score")).join(yes, ["script", "question"]).withColumnRenamed("script", "origin")


def run(args: argparse.Namespace, spark: SparkSession) -> DataFrame | None:
    """The result of a command as a DataFrame; None where it wrote files of its own."""
    c = args.command
    if c == "features":
        return script_features.extract(files.scripts(spark, args.scripts))
    if c == "census":
        return census(files.scripts(spark, args.scripts))
    if c == "sample":
        table = census(files.scripts(spark, args.scripts)).withColumnRenamed("points", "rubric_points").withColumnRenamed("band", "rubric_band")
        return sampling.select(table, args.n, BAND_RANGES, args.seed)
    if c == "card":
        docs = files.script_documents(census(files.scripts(spark, args.scripts)), files.read_judgements(spark, args.judgements) if args.judgements else None)
        return cards.state(cards.cards(docs, F.col("purpose"))).select("origin", "purpose", "structure", "facts", "approx_tokens", "within_budget", "state")
    if c == "calibrate":
        return metrics.ols_line(spark.read.schema("card_tokens double, ms double").option("header", "true").csv(args.points), "card_tokens", "ms")
    if c == "derive-labels":
        return labels.derive(script_features.extract(files.scripts(spark, args.scripts)), script_features.extract(files.scripts(spark, args.migrated)))
    if c == "export-training":
        judged = files.read_judgements(spark, args.judgements) if args.judgements else None
        docs = cards.cards(files.script_documents(census(files.scripts(spark, args.scripts)), judged), F.col("purpose"))
        names = (*BOOLEAN, "migration_complexity", "rewrite_strategy")
        gold = F.map_filter(F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*[F.col(n).cast("string") for n in names])), lambda _, v: v.isNotNull())
        with open(args.questions, encoding="utf-8") as f:
            asked = json.load(f)
        cases = training.split_families(training.build_cases(docs.withColumn("id", F.col("origin")).withColumn("gold", gold), asked))
        training.write_jsonl(cases, args.out)
        return None
    answers, gold = graded(spark, args)
    if c in ("decide", "report"):
        outcomes = decisions.grade(answers, gold)
        if c == "report":
            return metrics.per_question(outcomes)
        decided = decisions.decide(outcomes)
        if args.out:
            files.write_decisions(outcomes, decided, args.out)
            return None
        return decided
    rows = binary(answers, gold)
    if c == "baseline":
        docs = regression.with_marker_count(files.script_documents(census(files.scripts(spark, args.scripts)), files.read_judgements(spark, args.judgements) if args.judgements else None))
        docs = docs.withColumn("row_id", F.xxhash64("origin"))
        found = None
        for question, leaky in regression.LEAKY.items():
            if question in docs.columns:
                own = answers.where((F.col("question") == question) & (F.col("type") == "noul")).select(F.col("script").alias("_script"), F.col("value_num").alias("score"))
                table = docs.join(own, docs["origin"] == own["_script"], "left").withColumn("gold", F.col(question).cast("boolean"))
                one = regression.baseline(table, list(regression.FEATURES), "gold", "row_id", list(leaky), "score").select(F.lit(question).alias("question"), "*")
                found = one if found is None else found.union(one)
        return found
    if c == "compare":
        other = binary(*graded(spark, args, args.other))
        known = rows.select("origin", "question", "gold_bool")
        return comparison.compare_runs(rows.select("origin", "question", "score"), other.select("origin", "question", "score"), known)
    if c == "paired":
        docs = files.script_documents(census(files.scripts(spark, args.scripts)))
        wanted = [f"{args.question}_p{i}" for i in range(1, args.paraphrases + 1)] if args.paraphrases else [args.question]
        scores = comparison.aggregate_scores(answers, wanted).withColumnRenamed("script", "origin")
        table = docs.join(scores, "origin").withColumn("row_id", F.xxhash64("origin")).withColumn("gold", F.col(args.question))
        splits = comparison.seeded_splits(spark, regression.labelled_groups(table, "gold", "row_id"), args.splits, args.seed)
        table = regression.with_marker_count(table)
        features, leaky = list(regression.FEATURES), list(regression.LEAKY[args.question])
        return regression.paired_summary(regression.paired_splits(table, splits, features, "gold", "score", "row_id", leaky))
    if c == "ensemble":
        wordings = sorted(r[0] for r in answers.where(F.col("question").startswith(f"{args.question}_p")).select("question").distinct().limit(MAX_WORDINGS + 1).collect())
        if len(wordings) > MAX_WORDINGS:
            raise ValueError(f"more than {MAX_WORDINGS} wordings of {args.question}")
        x = answers.where(F.col("question").isin(wordings)).groupBy("script").agg(F.transform(F.array_sort(F.collect_list(F.struct("question", "value_num"))), lambda s: s["value_num"]).alias("x"))
        truth = gold.where(F.col("question") == args.question).select("script", (F.col("gold") == "true").alias("gold_bool"))
        return comparison.ensemble(x.join(truth, "script"), "x", len(wordings))
    if c == "variants":
        parts = answers.withColumn("variant", F.regexp_extract("question", r"_(v\d+)$", 1)).withColumn("question", F.regexp_replace("question", r"_v\d+$", ""))
        truth = gold.select("script", "question", (F.col("gold") == "true").alias("gold_bool"))
        return comparison.variant_probe(parts.where("variant <> ''").select("script", "question", "variant", F.col("value_num").alias("score")).join(truth, ["script", "question"]))
    if c == "business":
        truth = gold.where("question = 'migration_complexity'").select("script", comparison.level_of(F.col("gold")).alias("level"))
        value = comparison.expected_level(F.transform("probabilities", lambda p: p["p"]))
        return comparison.ordinal_scores(answers.where("type = 'score'").select("script", "question", value.alias("value")).join(truth, "script"), ["question"])
    raise ValueError(c)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="scriptloom", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    for c in ("features", "census", "sample", "card", "calibrate", "derive-labels", "export-training", "decide", "report", "baseline", "compare", "paired", "ensemble", "variants", "business"):
        s = sub.add_parser(c)
        s.add_argument("--scripts", help="folder of .sql files")
        s.add_argument("--run", help="folder of a run's JSON documents")
        s.add_argument("--judgements", help="JSON lines of judgements by origin")
        s.add_argument("--out", help="where to write (Parquet, or the command's own form)")
        s.add_argument("--seed", type=int, default=42)
        s.add_argument("--n", type=int, default=20)
        s.add_argument("--points", help="CSV of card_tokens, ms")
        s.add_argument("--migrated", help="folder of migrated .sql files")
        s.add_argument("--questions", help="JSON list of typed questions")
        s.add_argument("--other", help="folder of the run to compare with")
        s.add_argument("--question", default="has_subquery")
        s.add_argument("--paraphrases", type=int, default=0)
        s.add_argument("--splits", type=int, default=200)
    return p


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    found = run(args, SparkSession.getActiveSession() or local_session())
    if found is not None:
        if args.out:
            found.write.mode("overwrite").parquet(args.out)
        else:
            found.show(200, truncate=False)


if __name__ == "__main__":
    main()
