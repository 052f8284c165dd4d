"""Dataset creation shell: work lists, splits, sampling and the circuit breaker."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.operators.scan import KeyScan, Running, quota_cut


def work_list(fonts: DataFrame, classes: DataFrame, done: DataFrame) -> DataFrame:
    """Every font with every class that isn't done. fonts: (font_stem, ...); classes: (class_id, ...); done: (class_id, font_stem).
    The product is the work itself; what is done is taken off by an anti join."""
    return fonts.crossJoin(classes).join(done.select("class_id", "font_stem").distinct(), ["class_id", "font_stem"], "left_anti")


def seeded(*columns: Column | str, seed: int = 0) -> Column:
    """A repeatable random order."""
    return F.xxhash64(F.lit(seed), *columns)


def tier_split(rows: DataFrame, tier: str, order: list[Column | str], share: float = 0.7) -> DataFrame:
    """`rows` with `split`: the first max(1, floor(share * n)) of each tier in `order` train, and the others test. See `quota_cut`: no tier is sorted whole."""
    cut_off = quota_cut(rows, [tier], order, lambda n: F.greatest(F.lit(1), F.floor(F.lit(share) * n)), name="__train")
    return cut_off.withColumn("split", F.when(F.col("__train"), "train").otherwise("test")).drop("__train")


def stratified_split(rows: DataFrame, strata: list[str], order: list[Column | str], share: float = 0.8) -> DataFrame:
    """As `tier_split` over several columns, with train and val."""
    cut_off = quota_cut(rows, strata, order, lambda n: F.floor(F.lit(share) * n + 0.5), name="__train")
    return cut_off.withColumn("split", F.when(F.col("__train"), "train").otherwise("val")).drop("__train")


def sample_groups(rows: DataFrame, group: str, n: int, seed: int = 0, order: list[Column] | None = None, fill: str | None = None) -> DataFrame:
    """All rows of n groups, drawn by a seeded hash or the first in `order`. With `fill`, the first rows without a group, in its order, stand in for
    the groups that are lacking. The sample is the feature."""
    drawn = rows.select(group).filter(F.col(group).isNotNull()).distinct().orderBy(*(order or [seeded(group, seed=seed), group])).limit(n)
    kept = rows.join(drawn, group, "left_semi")
    if fill is None:
        return kept
    place = F.row_number().over(Window.orderBy(fill))
    rest = rows.filter(F.col(group).isNull()).orderBy(fill).limit(n).withColumn("__k", place)  # n rows at most
    lacking = drawn.agg((F.lit(n) - F.count("*")).alias("__lacking"))
    return kept.unionByName(rest.join(F.broadcast(lacking), F.col("__k") <= F.col("__lacking")).drop("__k", "__lacking"))  # one row


def remapped(rows: DataFrame, column: str, names: dict[str, str]) -> DataFrame:
    """`rows` with `column` replaced where `names` holds it."""
    known = F.create_map(*[F.lit(x) for pair in names.items() for x in pair]) if names else None
    return rows.withColumn(column, F.coalesce(F.try_element_at(known, F.col(column)), F.col(column))) if names else rows


def epoch_means(batches: DataFrame, epoch: str, measures: list[str], size: str) -> DataFrame:
    """Each epoch's means of the batches' measures, weighted by the batches' sizes, and the sum of these."""
    means = [(F.sum(F.col(m) * F.col(size)) / F.sum(size)).alias(m) for m in measures]
    return batches.groupBy(epoch).agg(*means, F.sum(size).alias(size))


def sample_rows(rows: DataFrame, key: str, n: int, seed: int = 0, draw: Column | None = None) -> DataFrame:
    """Exactly min(n, all) rows, drawn by a seeded hash of `key`, or by `draw`. The sample is the feature."""
    return rows.orderBy(seeded(key, seed=seed) if draw is None else draw, key).limit(n)


def breaker(
    attempts: DataFrame, key: str, order: str, failed: Column, max_run: int = 100, max_rate: float = 0.40, min_attempts: int = 200, long: list | None = None
) -> DataFrame:
    """`attempts` up to each key's first trip, which is included: `max_run` failures in a row, or a failure rate of `max_rate`
    from `min_attempts` on. Adds n_attempts, n_failed, run_length and tripped. A long key is scanned by blocks (see `KeyScan` for `long`)."""
    scan = KeyScan(attempts.withColumn("__f", F.coalesce(failed, F.lit(False)).cast("int")), key, [order], long)
    scan.running(n_attempts=Running("sum", F.lit(1)), n_failed=Running("sum", F.col("__f")))
    scan.running(__good=Running("max", F.when(F.col("__f") == 0, F.col("n_attempts"))))
    rate = F.col("n_failed") / F.col("n_attempts")
    trips = (F.col("run_length") >= max_run) | ((F.col("n_attempts") >= min_attempts) & (rate >= max_rate))
    scan.map(lambda d: d.withColumn("run_length", (F.col("n_attempts") - F.coalesce("__good", F.lit(0))).cast("int")).withColumn("tripped", trips))
    out = scan.totals(__stop=F.min(F.when(F.col("tripped"), F.col("n_attempts")))).frame()
    out = out.filter(F.col("__stop").isNull() | (F.col("n_attempts") <= F.col("__stop")))
    return out.withColumns({c: F.col(c).cast("int") for c in ("n_attempts", "n_failed")}).drop("__f", "__stop", "__good")


#: Epochs of a key that are averaged together; the last of each such stretch are told to the next.
STRETCH = 4096


def best_so_far(epochs: DataFrame, key: str, order: str, loss: str, patience: int = 5, long: list | None = None) -> DataFrame:
    """`epochs` with best (running least), since_best (epochs since it was reached), ma5 (mean of the last five) and stopped.

    A long key is scanned by blocks. The mean of five needs four rows from before: a key is cut into stretches of STRETCH rows, and the last four of each
    stand before the next one as well."""
    scan = KeyScan(epochs, key, [order], long)
    scan.running(__before=Running("min", F.col(loss), before=True), best=Running("min", F.col(loss)), __n=Running("sum", F.lit(1)))
    scan.map(lambda d: d.withColumn("__new", F.when(F.col("__before").isNull() | (F.col(loss) < F.col("__before")), F.col("__n"))))
    out = scan.running(__reached=Running("max", F.col("__new"))).frame()
    out = out.withColumn("since_best", (F.col("__n") - F.col("__reached")).cast("int")).withColumn("__at", F.floor((F.col("__n") - 1) / STRETCH))
    told = F.when((F.col("__n") - 1) % STRETCH >= STRETCH - 4, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))
    out = out.withColumn("__told", F.explode(told)).withColumn("__at", F.col("__at") + F.col("__told").cast("int"))
    five = Window.partitionBy(key, "__at").orderBy("__n").rowsBetween(-4, 0)
    out = out.withColumn("ma5", F.avg(loss).over(five)).filter(~F.col("__told"))
    return out.withColumn("stopped", F.col("since_best") >= patience).drop("__before", "__n", "__new", "__reached", "__at", "__told")
