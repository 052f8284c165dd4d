"""Grid analysis over a fact table (stem, parameters, cer): correlation, quadratic response, slope ratios, census and anchors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scriptorium.functions.text import correlation_verdict

# The swept parameters and their grids.
FULL_GRID = {
    "smoothing_k": [1.0, 3.0, 5.0],
    "close_k": [2.0, 3.0, 5.0],
    "window_pad": [4.0, 8.0, 12.0, 20.0],
    "multi_seg_threshold": [95.0, 97.0, 99.0],
}
QUICK_GRID = {"smoothing_k": [1.0, 3.0], "close_k": [2.0, 3.0], "window_pad": [8.0, 12.0], "multi_seg_threshold": [95.0, 97.0]}
TIE = 1e-9


def grid_frame(spark: SparkSession, grid: dict[str, list[float]]) -> DataFrame:
    """All combinations, the last parameter varying fastest, with `ordinal` and `run_tag`."""
    out = spark.range(1).select(F.lit(0).alias("ordinal"))
    for name, values in grid.items():
        out = out.select("*", F.posexplode(F.array(*map(F.lit, values))).alias("__k", name))
        out = out.withColumn("ordinal", F.col("ordinal") * len(values) + F.col("__k")).drop("__k")
    return out.withColumn("run_tag", F.format_string("run_%05d", F.col("ordinal")))


def upper_median(values: list[float]) -> float:
    return sorted(values)[len(values) // 2]


def ranked_runs(fact: DataFrame, params: list[str]) -> DataFrame:
    """Mean cer of each combination over its valid rows (cer not null), with their number."""
    return fact.groupBy(*params).agg(F.avg("cer").alias("mean_cer"), F.count("cer").alias("n_valid"))


def rank_combinations(fact: DataFrame, params: list[str]) -> DataFrame:
    """(parameters, ordinal, mean_cer, n_valid, rank): combinations by mean cer, those without a valid run last, equal ones by ordinal.
    There are as many rows as the grid has combinations, so one task ranks them."""
    found = fact.groupBy(*params).agg(F.min("ordinal").alias("ordinal"), F.avg("cer").alias("mean_cer"), F.count("cer").alias("n_valid"))
    return found.withColumn("rank", F.row_number().over(Window.orderBy(F.asc_nulls_last("mean_cer"), "ordinal")))


def top_combination(counted: DataFrame, params: list[str]) -> DataFrame:
    """The combination that is best for most stems; of equal ones the least."""
    return counted.orderBy(F.desc("frequency"), *params).limit(1)


def pearson(x, y):
    """Correlation from population moments; 0 for no variance or a single row."""
    return F.coalesce(F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)), F.lit(0.0))


def correlations(runs: DataFrame, params: list[str]) -> DataFrame:
    """(param, r, verdict) of each parameter's correlation with mean_cer, in one pass; r has four decimals."""
    wide = runs.agg(*[(F.bround(pearson(F.col(p), F.col("mean_cer")), 4) + 0.0).alias(p) for p in params])
    long = wide.unpivot([], params, "param", "r")
    return long.withColumn("verdict", correlation_verdict(F.col("r")))


def quadratic_slopes(runs: DataFrame, grid: dict[str, list[float]]) -> DataFrame:
    """(param, slope, direction, sensitivity): with the other parameters at their upper medians, the mean cer at each value of
    a parameter is fitted by a polynomial of degree min(2, values - 1), and the slope is taken at the upper median.

    The normal equations of the few bucket means are solved by Cramer's rule from power sums, about the median so that
    they are well conditioned. direction is 1 for a falling slope and else -1. Fewer than two values give (1, 0).
    """
    middle = {p: upper_median(v) for p, v in grid.items()}
    points = []
    for p in grid:
        others = F.lit(True)
        for q in grid:
            if q != p:
                others = others & (F.col(q) == middle[q])
        points.append(F.when(others, F.struct(F.lit(p).alias("param"), (F.col(p) - middle[p]).alias("x"))))
    # one pass: a run is a point for each parameter whose others are at their medians
    long = runs.select("mean_cer", F.explode(F.array(*points)).alias("at")).filter("at IS NOT NULL").select("at.param", "at.x", "mean_cer")
    means = long.groupBy("param", "x").agg(F.avg("mean_cer").alias("y"))
    sums = means.groupBy("param").agg(
        F.count("*").alias("n"), *[F.sum(F.pow("x", F.lit(k))).alias(f"s{k}") for k in (1, 2, 3, 4)],
        F.sum("y").alias("t0"), F.sum(F.col("x") * F.col("y")).alias("t1"), F.sum(F.col("x") * F.col("x") * F.col("y")).alias("t2"),
    )
    line = F.try_divide(F.expr("n * t1 - s1 * t0"), F.expr("n * s2 - s1 * s1"))
    # slope at x = 0 of y = c + b x + a x^2 is b
    curve = F.try_divide(
        F.expr("n * (t1 * s4 - s3 * t2) - t0 * (s1 * s4 - s3 * s2) + s2 * (s1 * t2 - t1 * s2)"),
        F.expr("n * (s2 * s4 - s3 * s3) - s1 * (s1 * s4 - s3 * s2) + s2 * (s1 * s3 - s2 * s2)"),
    )
    slope = F.when(F.col("n") >= 3, curve).when(F.col("n") == 2, line)
    fitted = sums.select("param", slope.alias("slope"))
    every = long.sparkSession.createDataFrame([(p,) for p in grid], "param string")
    return every.join(F.broadcast(fitted), "param", "left").select(  # a row per parameter
        "param",
        F.coalesce("slope", F.lit(0.0)).alias("slope"),
        F.when(F.col("slope").isNull() | (F.col("slope") < 0), 1).otherwise(-1).alias("direction"),
        F.bround(F.abs(F.coalesce("slope", F.lit(0.0))), 4).alias("sensitivity"),
    )


def slope_ratios(slopes: DataFrame) -> DataFrame:
    """(a, b, ratio) of all pairs of parameters: 1 on the diagonal, 0 where b's slope is 0; four decimals."""
    every = slopes.agg(F.collect_list(F.struct("param", "slope")).alias("every"))  # as many as there are parameters; the slopes are computed once
    pairs = every.select("every", F.explode("every").alias("x")).select("x", F.explode("every").alias("y"))
    ratio = F.when(F.col("x.param") == F.col("y.param"), F.lit(1.0)).otherwise(F.bround(F.coalesce(F.try_divide("x.slope", "y.slope"), F.lit(0.0)), 4))
    return pairs.select(F.col("x.param").alias("a"), F.col("y.param").alias("b"), ratio.alias("ratio"))


def ratio_matrix(ratios: DataFrame, params: list[str]) -> DataFrame:
    return ratios.groupBy("a").pivot("b", params).agg(F.first("ratio"))


def best_combinations(fact: DataFrame, params: list[str]) -> DataFrame:
    """The rows of `fact` whose cer ties their stem's least within TIE."""
    least = F.min("cer").over(Window.partitionBy("stem"))
    return fact.filter("cer IS NOT NULL").withColumn("__least", least).filter(F.col("cer") <= F.col("__least") + TIE).drop("__least")


def census(fact: DataFrame, params: list[str]) -> DataFrame:
    """How many stems each combination is best for."""
    return best_combinations(fact, params).groupBy(*params).agg(F.count("*").alias("frequency"))


def anchors(fact: DataFrame, counted: DataFrame, params: list[str], tiebreak: str) -> DataFrame:
    """Each stem's best combination: by census frequency, then the greatest `tiebreak`, then the least combination."""
    best = best_combinations(fact, params).join(counted, params, "left")
    order = Window.partitionBy("stem").orderBy(F.desc(F.coalesce("frequency", F.lit(0))), F.desc(tiebreak), *params)
    return best.withColumn("__k", F.row_number().over(order)).filter("__k = 1").select("stem", *params, "cer")


def profiles(found: DataFrame, params: list[str]) -> DataFrame:
    """Distinct best combinations with their least best_cer and the number of stems."""
    return found.groupBy(*params).agg(F.min("best_cer").alias("best_cer"), F.count("*").alias("n_stems"))
