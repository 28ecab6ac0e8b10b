"""Stratified samples of a corpus, and what they cover."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranking import number_within

from .rubric import percentile_rank

# Metrics whose largest script is always considered, in order, and those that a pick is placed by.
FORCED_MAXIMA = ("subquery_count", "graph_nodes", "set_operation_count", "case_expression_count", "window_function_count", "statements", "graph_max_scope_sources")
PLACED_BY = ("rubric_points", "loc_code", "source_tables", "subquery_count", "cte_count", "graph_edges", "graph_max_scope_sources")

#: Places up to which Spark drops rows by group before it exchanges them (spark.sql.optimizer.windowGroupLimitThreshold).
FEW_PLACES = 1000
#: Scripts of a corpus that the exact (seeded) sampler takes to the driver at most.
MAX_SCRIPTS = 100_000


def tolerant_int(c: Column) -> Column:
    """Whole part of a number that may be text; 0 if it is none."""
    return F.coalesce(c.try_cast("double"), F.lit(0.0)).cast("long")


def quotas(df: DataFrame, band: str, total: int) -> DataFrame:
    """band, size, quota: shares of ``total`` by size, rounded down; what is left goes one by one to the largest bands, ties by name."""
    sizes = df.groupBy(band).agg(F.count(F.lit(1)).alias("size"))
    # One row for each band.
    everything = Window.partitionBy(F.lit(0))
    base = F.floor(total * F.col("size") / F.sum("size").over(everything)).cast("long")
    table = sizes.withColumn("base", base).withColumn("place", F.row_number().over(everything.orderBy(F.desc("size"), band)))
    left = total - F.sum("base").over(everything)
    return table.withColumn("quota", F.col("base") + (F.col("place") <= left).cast("long")).select(band, "size", "quota")


def forced_maxima(df: DataFrame, name: str, metrics: list[str]) -> DataFrame:
    """metric, name, value: the row of each metric's largest value, ties to the largest name; none where it is 0."""
    picks = [F.max_by(F.struct(F.lit(m).alias("metric"), F.col(name).alias("name"), F.col(m).cast("long").alias("value")), F.struct(F.col(m), F.col(name))).alias(f"_{i}") for i, m in enumerate(metrics)]
    one = df.agg(*picks)
    return one.select(F.explode(F.array(*[F.col(f"_{i}") for i in range(len(metrics))])).alias("p")).select("p.*").where("value > 0")


def boundary_rows(df: DataFrame, points: str, cuts: list[int]) -> DataFrame:
    """cut, side, and the number of rows with just those points: the pools that boundary picks are drawn from."""
    sides = [F.struct(F.lit(c).cast("long").alias("cut"), F.lit(s).alias("side"), F.lit(c + d).cast("long").alias("at")) for c in cuts for s, d in (("below", 0), ("above", 1))]
    spots = df.sparkSession.range(1).select(F.explode(F.array(*sides)).alias("s")).select("s.*")
    counts = df.groupBy(F.col(points).cast("long").alias("at")).agg(F.count(F.lit(1)).alias("n"))
    return spots.join(counts, "at").select("cut", "side", "n")


def drawn_by(name: str, seed: int) -> Column:
    """The MD5 of seed and name, whose order is that in which rows of a score are drawn."""
    return F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col(name).cast("string"), F.lit(""))))


def first_of_scores(df: DataFrame, name: str, band: str, points: str, n: int, seed: int) -> DataFrame:
    """The rows that may have one of the first ``n`` turns of their band: of each score the first ``n`` drawn.

    A row's turn comes after those of all rows of its score that are drawn before it, and turns among the rows
    that are left are those among all.  Tasks drop what can't be among the first before rows are exchanged.
    """
    drawn = Window.partitionBy(band, points).orderBy(drawn_by(name, seed), name)
    return df.withColumn("_drawn", F.row_number().over(drawn)).where(F.col("_drawn") <= n).drop("_drawn")


def spread_within_band(df: DataFrame, name: str, band: str, points: str, seed: int = 42) -> DataFrame:
    """Add ``turn``: the place at which a row of its band is taken when scores take turns (lowest, highest, second lowest, ...).

    Rows of a score are in the order of the MD5 of seed and name; no band or score is gathered in a task.  This is the sampler for corpora
    that don't fit the driver; ``select`` draws with the seeded generator.
    """
    scores = df.groupBy(band, points).agg(F.count(F.lit(1)).alias("_c"))
    up, down = Window.partitionBy(band).orderBy(points), Window.partitionBy(band).orderBy(F.desc(points))
    low, high = F.row_number().over(up), F.row_number().over(down)
    side = scores.withColumn("_low", low).withColumn("_high", high).select(F.col(band).alias("_b"), F.col(points).alias("_p"), F.when(F.col("_low") <= F.col("_high"), 2 * F.col("_low") - 1).otherwise(2 * F.col("_high")).alias("_alternation"))
    mixed = df.withColumn("_hash", drawn_by(name, seed))
    rounds = number_within(mixed, [band, points], ["_hash", name], "_round")
    ranked = rounds.join(side, (F.col(band) == F.col("_b")) & (F.col(points) == F.col("_p")))
    turns = number_within(ranked, [band], ["_round", "_alternation", name], "_turn")
    return turns.withColumn("turn", (F.col("_turn") + 1).cast("long")).select(*df.columns, "turn")


def stratified_fill(df: DataFrame, name: str, band: str, points: str, total: int, seed: int = 42) -> DataFrame:
    """The rows that fill ``total`` places: bands by quota, scores in turns within each."""
    plan = quotas(df, band, total).select(F.col(band).alias("_band"), "quota")
    turns = spread_within_band(first_of_scores(df, name, band, points, total, seed) if total <= FEW_PLACES else df, name, band, points, seed)
    # One row for each band.
    return turns.join(F.broadcast(plan), F.col(band) == F.col("_band")).where(F.col("turn") <= F.col("quota")).drop("_band", "quota")


def coverage_summary(df: DataFrame, band: str, points: str) -> DataFrame:
    """n, bands, least and most points, and the nearest-rank p90 of points."""
    n = F.count(F.lit(1))
    ordered = F.array_sort(F.collect_list(F.struct(F.col("p"), F.col("c"))))
    counts = df.groupBy(F.col(points).cast("long").alias("p")).agg(n.alias("c"))
    folded = counts.agg(ordered.alias("h"), F.sum("c").alias("n"))
    rank = F.greatest(F.lit(1), F.least(F.col("n"), F.bround(F.lit(0.9) * F.col("n") + F.lit(0.5)).cast("long")))
    p90 = F.aggregate("h", F.struct(F.lit(0).cast("long").alias("upto"), F.lit(None).cast("long").alias("v")), lambda a, x: F.struct((a["upto"] + x["c"]).alias("upto"), F.when((a["upto"] < rank) & (rank <= a["upto"] + x["c"]), x["p"]).otherwise(a["v"]).alias("v")))["v"]
    bands = df.agg(F.countDistinct(band).alias("bands"), F.min(points).cast("long").alias("least"), F.max(points).cast("long").alias("most"))
    return folded.select("n", p90.alias("p90")).crossJoin(bands).select("n", "bands", "least", "most", "p90")


def select(rows: DataFrame, n: int, bands: dict[str, tuple[int, int | None]], seed: int = 42) -> DataFrame:
    """id, origin, rubric_points, rubric_band, selected_because, corpus_percentile of ``n`` scripts, by one seeded generator.

    First a script on each side of each band's cut, then those with the largest metrics
    (a third of places, 3 at least, stay free), then bands by quota with scores in turns.
    ``rows`` has name, rubric_points, rubric_band and the metrics; it comes to the driver.
    """
    spark = rows.sparkSession
    metrics = [m for m in {*FORCED_MAXIMA, *PLACED_BY} if m in rows.columns]
    table = [r.asDict() for r in rows.select("name", "rubric_band", *[tolerant_int(F.col(m)).alias(m) for m in sorted({*metrics, "rubric_points"})]).limit(MAX_SCRIPTS + 1).collect()]
    if len(table) > MAX_SCRIPTS:
        raise ValueError(f"more than {MAX_SCRIPTS} scripts: use stratified_fill")
    table.sort(key=lambda r: r["name"])
    rng, why = random.Random(seed), {}
    for label, key in (("low/medium", "low"), ("medium/high", "medium")):
        cut = bands.get(key, (0, 0))[1]
        for side, at in (("below", cut), ("above", None if cut is None else cut + 1)):
            pool = [r for r in table if at is not None and r["rubric_points"] == at]
            if pool:
                name = rng.choice(pool)["name"]
                why.setdefault(name, []).append(f"just {side} {label} (points={at})")
    budget = max(0, n - len(why) - max(3, n // 3))
    for m in FORCED_MAXIMA:
        if budget <= 0 or not table or m not in metrics:
            continue
        top = max(table, key=lambda r: (r[m], r["name"]))
        if top[m] > 0 and top["name"] not in why:
            why[top["name"]] = [f"largest {m} ({m}={top[m]})"]
            budget -= 1
    free = [r for r in table if r["name"] not in why]
    for band, names in _fill(free, n - len(why), rng):
        for name, points in names:
            why.setdefault(name, []).append(f"fills {band} ({points} points)")
    places = rows
    for m in [x for x in PLACED_BY if x in rows.columns]:
        places = percentile_rank(places.withColumn("_all", F.lit(1)), ["_all"], m, f"_at_{m}").drop("_all")
    placed = F.map_from_arrays(F.array(*[F.lit(m) for m in PLACED_BY if m in rows.columns]), F.array(*[F.col(f"_at_{m}") for m in PLACED_BY if m in rows.columns]))
    by_name = {r["name"]: r for r in table}
    order = sorted(why, key=lambda x: by_name[x]["rubric_points"])
    picks = spark.createDataFrame([(f"script_{i:02d}", x, why[x]) for i, x in enumerate(order, 1)], "id string, origin string, selected_because array<string>")
    return picks.join(places.withColumn("corpus_percentile", placed), picks["origin"] == places["name"]).select("id", "origin", F.col("rubric_points").cast("long").alias("rubric_points"), "rubric_band", "selected_because", "corpus_percentile")


def _fill(free: list[dict], total: int, rng: random.Random) -> list[tuple[str, list[tuple[str, int]]]]:
    pools: dict[str, dict[int, list[str]]] = {}
    for r in free:
        pools.setdefault(r["rubric_band"], {}).setdefault(r["rubric_points"], []).append(r["name"])
    sizes = {b: sum(map(len, p.values())) for b, p in pools.items()}
    if total <= 0 or not sizes:
        return []
    quota = {b: total * s // sum(sizes.values()) for b, s in sizes.items()}
    for b in sorted(sizes, key=lambda b: -sizes[b])[: total - sum(quota.values())]:
        quota[b] += 1
    out = []
    for band, pool in pools.items():
        scores = sorted(pool)
        turns = [scores[i // 2] if i % 2 == 0 else scores[-1 - i // 2] for i in range(len(scores))]
        for s in scores:  # each score is shuffled once, in their order
            rng.shuffle(pool[s])
        rounds = max(map(len, pool.values()))
        taken = [(pool[s][k], s) for k in range(rounds) for s in turns if k < len(pool[s])]
        out.append((band, taken[: quota[band]]))
    return out
