"""Training cases, families of near-identical scripts and splits that keep them whole."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.workspace import write_table
from .ranking import number_within

# The counts of a family's fingerprint, in order, and the shares of the splits.
FAMILY_KEYS = ("source_tables", "subquery_count", "cte_count", "window_function_count", "set_operation_count", "max_nesting_depth", "graph_edges", "statements")
SPLITS = {"train": 0.70, "calibration": 0.10, "test": 0.20}


def family_key(columns: list[str], sources: str | None = "distinct_sources") -> Column:
    """First 12 hex digits of the SHA-1 of counts and sorted sources; missing counts are 0."""
    parts = [F.concat(F.lit(f"{k}="), F.coalesce(F.col(k).cast("string"), F.lit("0")) if k in columns else F.lit("0")) for k in FAMILY_KEYS]
    listed = F.array_join(F.array_sort(F.coalesce(F.col(sources), F.array().cast("array<string>"))), ",") if sources and sources in columns else F.lit("")
    return F.substring(F.sha1(F.concat_ws("|", *parts, F.concat(F.lit("sources="), listed))), 1, 12)


def deal(sizes: list[tuple[int, int]], fractions: dict[str, float]) -> list[tuple[int, str, int, int]]:
    """Of each (size, families of that size) the ranks that go to each split: size, split, first rank, end.

    Families go one by one, the largest first, to the split that is furthest below its share (the first of several).
    Families of one size are alike, so a run of them is dealt at once: all splits are filled to one level, but for the
    last few families, and only those are dealt one by one.
    """
    total = sum(n * k for n, k in sizes)
    held, out = dict.fromkeys(fractions, 0), []
    for n, k in sorted(sizes, reverse=True):
        lack = {s: f * total - held[s] for s, f in fractions.items()}
        filled = lambda level: {s: max(0, math.floor((x - level) / n)) for s, x in lack.items()}
        high, low = max(lack.values()), min(lack.values()) - (k + 1.0) * n
        for _ in range(80):
            level = (high + low) / 2
            high, low = (level, low) if sum(filled(level).values()) <= k else (high, level)
        got = {s: max(0, x - 1) for s, x in filled(high).items()}
        for s in fractions:
            held[s] += n * got[s]
        for _ in range(k - sum(got.values())):
            s = min(fractions, key=lambda s: held[s] - fractions[s] * total)
            held[s] += n
            got[s] += 1
        at = 0
        for s in fractions:
            if got[s]:
                out.append((n, s, at, at + got[s]))
            at += got[s]
    return out


def split_families(cases: DataFrame, family: str = "family", fractions: dict[str, float] | None = None, seed: int = 42) -> DataFrame:
    """Add ``split``: families whole, the largest first, each to the split that is furthest below its share.

    Families of one size are ranked by the MD5 of seed and family, and the splits take ranks in their order.  Only the
    histogram of sizes comes to the driver (of N cases fewer than the root of 2 N sizes).  A null family is a family.
    """
    sizes = write_table(cases.groupBy(F.col(family).alias("_family")).agg(F.count(F.lit(1)).alias("_size")), "families")
    counts = [(r["_size"], r["k"]) for r in sizes.groupBy("_size").agg(F.count(F.lit(1)).alias("k")).collect()]
    key = F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col("_family").cast("string"), F.lit(""))))
    ranked = number_within(sizes.withColumn("_key", key), ["_size"], ["_key", "_family"], "_rank")
    runs = cases.sparkSession.createDataFrame(deal(counts, fractions or SPLITS), "_n long, split string, _first long, _end long")
    # A few rows for each size.
    placed = ranked.join(F.broadcast(runs), (F.col("_size") == F.col("_n")) & (F.col("_rank") >= F.col("_first")) & (F.col("_rank") < F.col("_end"))).select("_family", "split")
    return cases.join(placed, F.col(family).eqNullSafe(F.col("_family"))).drop("_family")


def label_counts(cases: DataFrame) -> DataFrame:
    """question, label, n: how often each label of each question is in the cases' gold; all n together are the decisions."""
    answers = F.from_json("gold", "map<string, struct<label: string>>")
    return cases.select(F.explode(answers).alias("question", "answer")).groupBy("question", F.col("answer.label").alias("label")).agg(F.count(F.lit(1)).alias("n"))


def split_report(cases: DataFrame, family: str = "family") -> DataFrame:
    """split, cases, families, and families that another split has too (must be 0)."""
    pairs = cases.select("split", F.col(family).alias("f")).distinct()
    shared = pairs.groupBy("f").agg(F.count(F.lit(1)).alias("k")).where("k > 1")
    counts = cases.groupBy("split").agg(F.count(F.lit(1)).alias("cases"), F.countDistinct(family).alias("families"))
    overlap = pairs.join(shared, "f").groupBy("split").agg(F.count(F.lit(1)).alias("overlap"))
    return counts.join(overlap, "split", "left").na.fill(0)


def build_cases(docs: DataFrame, questions: list[dict]) -> DataFrame:
    """id, origin, family, state, questions, gold (JSON) of documents with a card and a usable label.

    ``docs`` has id, name, purpose, structure, facts, the features and a map ``gold``
    (question -> label); a question has qid, type and, by type, criteria (options or
    levels).  A label that is no option is left out.
    """
    import json

    def encode(q: dict) -> Column:
        value = F.element_at("gold", q["qid"])
        options = ["true", "false"] if q["type"] == "noul" else list(q["criteria"])
        keys = [str(i) for i in range(len(options))] if q["type"] == "score" else options
        if q["type"] == "score":
            levels = F.array(*[F.lower(F.lit(str(o))) for o in options])
            bands = ["low", "medium", "high"]
            at = F.coalesce(*([F.nullif(F.array_position(F.array(*[F.lit(b) for b in bands]), value), F.lit(0).cast("long")) - 1] if len(options) == 3 else []), value.try_cast("long"), F.nullif(F.array_position(F.transform(levels, lambda o: F.startswith(o, F.lower(value))), F.lit(True)), F.lit(0).cast("long")) - 1)
            chosen = F.when((at >= 0) & (at < len(options)), at.cast("string"))
        else:
            chosen = F.when(value.isin(options), value)
        probabilities = F.map_from_arrays(F.array(*[F.lit(k) for k in keys]), F.array(*[F.when(chosen == k, 1.0).otherwise(0.0) for k in keys]))
        return F.when(chosen.isNotNull(), F.struct(F.lit(q["qid"]).alias("q"), F.struct(chosen.alias("label"), probabilities.alias("probabilities")).alias("a")))

    entries = F.array_compact(F.array(*[encode(q) for q in questions]))
    state = F.to_json(F.struct(F.coalesce("purpose", F.lit("")).alias("purpose"), F.coalesce("structure", F.lit("")).alias("structure"), F.coalesce("facts", F.lit("")).alias("metrics")))
    said = F.concat_ws("", "purpose", "structure", "facts") != ""
    made = docs.where(said).withColumn("_e", entries).where(F.size("_e") > 0)
    asked = json.dumps({q["qid"]: {k: v for k, v in q.items() if k != "qid"} for q in questions}, ensure_ascii=False)
    return made.select("id", F.col("name").alias("origin"), family_key(docs.columns).alias("family"), state.alias("state"), F.lit(asked).alias("questions"), F.to_json(F.map_from_entries("_e")).alias("gold"))


def write_jsonl(cases: DataFrame, path: str) -> None:
    """One folder of JSON lines for each split."""
    cases.write.mode("overwrite").partitionBy("split").json(path)
