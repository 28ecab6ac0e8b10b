"""Thresholds from percentiles, points, bands and their distributions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .profile import wide_percentiles
from .ranking import sum_before

BAND_ORDER = ("low", "medium", "high")


def percentile_rank(df: DataFrame, by: list[str], column: str, name: str) -> DataFrame:
    """Add ``name``: 100 x share of values at most this one, rounded half-even.  ``by`` has few distinct values."""
    counts = df.groupBy(*by, column).agg(F.count(F.lit(1)).alias("_c"))
    ranked = sum_before(counts, by, [column], "_c", "_before")
    totals = ranked.groupBy(*[F.col(c).alias(f"_t_{c}") for c in by]).agg(F.max(F.col("_before") + F.col("_c")).alias("_n"))
    on = F.lit(True)
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(f"_t_{c}"))
    # One row for each value of ``by``.
    upto = ranked.join(F.broadcast(totals), on).select(
        *[F.col(c).alias(f"_k_{c}") for c in [*by, column]], F.bround(100 * ((F.col("_before") + F.col("_c")) / F.col("_n")), 0).cast("long").alias(name)
    )
    same = F.lit(True)
    for c in [*by, column]:
        same = same & df[c].eqNullSafe(F.col(f"_k_{c}"))
    return df.join(upto, same).select(*df.columns, name)


def histogram(df: DataFrame, column: str, bins: int = 8) -> DataFrame:
    """bin, start, n of ``bins`` bins of equal width from least to largest value; the last holds the largest."""
    ends = df.agg(F.min(column).cast("double").alias("lo"), F.max(column).cast("double").alias("hi"))
    # One row of two numbers.
    step = (F.col("hi") - F.col("lo")) / bins
    at = F.when(step > 0, F.least(F.lit(bins - 1), F.floor((F.col(column) - F.col("lo")) / step))).otherwise(0).cast("long")
    counts = df.where(F.col(column).isNotNull()).crossJoin(F.broadcast(ends)).groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    grid = df.sparkSession.range(bins).withColumnRenamed("id", "bin").crossJoin(F.broadcast(ends))
    return grid.join(counts, "bin", "left").select("bin", (F.col("lo") + F.col("bin") * (F.col("hi") - F.col("lo")) / bins).alias("start"), F.coalesce("n", F.lit(0)).alias("n"))


def distribution(df: DataFrame, column: str) -> DataFrame:
    """Count and percentage of each value."""
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("_all"))
    return counts.crossJoin(F.broadcast(total)).select(column, "n", (100.0 * F.col("n") / F.col("_all")).alias("percent"))


def thresholds(features: DataFrame, scored: list[tuple[str, int, int | None]], stored: bool = False) -> DataFrame:
    """feature, lower, upper: percentiles as whole numbers, lower at least 1, upper over lower (null if there is none).

    ``stored`` says that ``features`` is a plain scan of files.
    """
    table = wide_percentiles(features, [x for x, _, _ in scored], tuple(sorted({p for _, lo, hi in scored for p in (lo, hi) if p})), stored)
    pick = lambda k: F.coalesce(*[F.when(F.col("feature") == s[0], F.col(f"p{s[k]}") if s[k] else F.lit(None)) for s in scored]).cast("long")
    lower = F.greatest(pick(1), F.lit(1))
    return table.select("feature", lower.alias("lower"), F.when(pick(2).isNotNull(), F.greatest(pick(2), lower + 1)).alias("upper"))


def score(features: DataFrame, limits: DataFrame, flat: list[tuple[str, str]]) -> DataFrame:
    """Add points (2 from the upper limit on, 1 from the lower; 1 for each flat rule) and their reasons, in order.

    ``limits`` has a row for each scored feature (some ten numbers), which become literals:
    no join, and the features are read once.  Values that are no numbers score nothing.
    """
    found = {r["feature"]: r for r in limits.collect()}
    points, reasons = F.lit(0).cast("long"), []
    for c in [x for x in features.columns if x in found]:
        value, lower, upper = F.col(c).cast("double"), found[c]["lower"], found[c]["upper"]
        tier = F.when(value >= F.lit(upper), 2).when(value >= F.lit(lower), 1).otherwise(0)
        points = points + tier
        reasons.append(F.when(tier > 0, F.concat(F.lit(f"{c}="), F.col(c).cast("string"), F.lit(" (+"), tier.cast("string"), F.lit(")"))))
    for name, rule in flat:
        fires = F.coalesce(F.expr(rule), F.lit(False))
        points = points + fires.cast("long")
        reasons.append(F.when(fires, F.lit(f"{name} (+1)")))
    return features.select(*features.columns, points.alias("points"), F.array_compact(F.array(*reasons)).alias("reasons"))


def band_for(df: DataFrame, bands: list[tuple[str, int, int | None]], points: str = "points") -> DataFrame:
    """Add ``band``: the first whose range holds the points, else high."""
    found = F.lit(None)
    for name, lo, hi in reversed(bands):
        inside = (F.col(points) >= lo) & (F.col(points) <= hi) if hi is not None else F.col(points) >= lo
        found = F.when(inside, name).otherwise(found)
    return df.withColumn("band", F.coalesce(found, F.lit("high")))


def band_distance(a: Column, b: Column) -> Column:
    """Steps between two bands; 99 if one is unknown."""
    order = F.array(*[F.lit(x) for x in BAND_ORDER])
    place = lambda c: F.nullif(F.array_position(order, c), F.lit(0).cast("long"))
    return F.coalesce(F.abs(place(a) - place(b)), F.lit(99).cast("long"))


def choose_bands(df: DataFrame, points: str) -> DataFrame:
    """t1, t2, low, medium, high: the cuts (t2 >= t1 + 2, no empty medium or high) whose bands are nearest to thirds.

    The first smallest cost wins.  Without such cuts: (least, least + 1, n, 0, 0); of an
    empty table: (3, 7, 0, 0, 0).  Works on the histogram of points, which is small.
    """
    counts = df.groupBy(F.col(points).cast("long").alias("p")).agg(F.count(F.lit(1)).alias("c"))
    ends = counts.agg(F.coalesce(F.max("p"), F.lit(-1)).alias("top"), F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.min("p").alias("least"))
    grid = ends.select(F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("top"), F.lit(0)))).alias("p"), "n", "least")
    upto = grid.join(counts, "p", "left").select("p", "n", "least", F.sum(F.coalesce("c", F.lit(0))).over(Window.partitionBy("n").orderBy("p")).alias("upto"))
    a, b = upto.alias("a"), upto.alias("b")
    pairs = a.join(b, F.col("a.n") == F.col("b.n")).where("b.p >= a.p + 2 AND b.upto > a.upto AND a.n > b.upto")
    third = F.col("a.n") / 3
    low, medium, high = F.col("a.upto"), F.col("b.upto") - F.col("a.upto"), F.col("a.n") - F.col("b.upto")
    cost = F.round(F.abs(low - third) + F.abs(medium - third) + F.abs(high - third), 6)
    row = F.struct(F.col("a.p").alias("t1"), F.col("b.p").alias("t2"), low.alias("low"), medium.alias("medium"), high.alias("high"))
    best = pairs.agg(F.min_by(row, F.struct(cost, F.col("a.p"), F.col("b.p"))).alias("r"))
    zero = F.lit(0).cast("long")
    none = F.when(F.col("n") == 0, F.struct(F.lit(3).cast("long").alias("t1"), F.lit(7).cast("long").alias("t2"), zero.alias("low"), zero.alias("medium"), zero.alias("high"))).otherwise(
        F.struct(F.col("least").alias("t1"), (F.col("least") + 1).alias("t2"), F.col("n").alias("low"), zero.alias("medium"), zero.alias("high"))
    )
    return best.crossJoin(ends).select(F.coalesce("r", none).alias("r")).select("r.*")


def extremes(df: DataFrame, name: str, points: str, top: int, bottom: int) -> DataFrame:
    """side, position, name, points: the highest and lowest scores, ties by name (a top-k, never a full sort)."""
    def side(label: str, keys: list[Column], k: int) -> DataFrame:
        some = df.select(name, points).orderBy(*keys).limit(k)
        return some.select(F.lit(label).alias("side"), F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*keys)).cast("long").alias("position"), name, points)

    return side("top", [F.desc(points), F.asc(name)], top).union(side("bottom", [F.asc(points), F.desc(name)], bottom))
