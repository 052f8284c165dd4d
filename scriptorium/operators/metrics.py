"""Error rates of recognised text against labels and a baseline, and their means."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.functions.text import cer, wer_long


def labelled(reference: Column) -> Column:
    return F.coalesce(F.length(reference) > 0, F.lit(False))


def with_labels(images: DataFrame, labels: DataFrame, key: str = "stem") -> DataFrame:
    """`images` with `ground_truth`, empty where there is no label. Spark broadcasts the labels if they are small."""
    return images.join(labels.select(key, "ground_truth"), key, "left").withColumn("ground_truth", F.coalesce("ground_truth", F.lit("")))


def with_baseline(images: DataFrame, baseline: DataFrame, key: str = "stem") -> DataFrame:
    """`images` (ground_truth) with base_text, base_cer and base_wer; rates only with both a label and a baseline text, which may be empty."""
    out = images.join(baseline.select(key, F.col("text").alias("base_text")), key, "left")
    both = labelled(F.col("ground_truth")) & F.col("base_text").isNotNull()
    return out.withColumn("base_cer", F.when(both, cer(F.col("base_text"), F.col("ground_truth")))).withColumn(
        "base_wer", F.when(both, wer_long(F.col("base_text"), F.col("ground_truth")))
    )


def with_rates(images: DataFrame) -> DataFrame:
    """`images` (predicted_text, ground_truth, n_segments if known) with cer and wer; an image without segments has 100 for both."""
    p, g = F.col("predicted_text"), F.col("ground_truth")
    none = F.col("n_segments") == 0 if "n_segments" in images.columns else F.lit(False)
    return images.withColumn("cer", F.when(none, F.lit(100.0)).otherwise(cer(p, g))).withColumn("wer", F.when(none, F.lit(100.0)).otherwise(wer_long(p, g)))


def macro_means(rated: DataFrame, *by: str, reference: str = "ground_truth") -> DataFrame:
    """Mean cer and wer over labelled rows, with the counts of rows and of labelled ones; null means without any."""
    has = labelled(F.col(reference))
    rates = [F.avg(F.when(has, F.col(c))).alias(f"mean_{c}") for c in ("cer", "wer") if c in rated.columns]
    return rated.groupBy(*by).agg(F.count("*").alias("n_images"), F.count_if(has).alias("n_labelled"), *rates)


def ranked(rows: DataFrame, value: str, tie: str) -> DataFrame:
    """`rows` with `rank` by `value`, nulls last. For aggregates of bounded size: a rank over all rows is one task's."""
    return rows.withColumn("rank", F.row_number().over(Window.orderBy(F.col(value).asc_nulls_last(), tie)))


def in_error_table(images: DataFrame, rates: DataFrame, key: str = "stem") -> DataFrame:
    """The images that have rates; others are skipped."""
    return images.join(rates.select(key), key, "left_semi")
