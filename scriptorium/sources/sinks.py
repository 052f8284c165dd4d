"""Writers of results: appended facts, ranked tables, and reports. Only one-row and report-sized results reach the driver."""

from __future__ import annotations

import html

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.functions.text import band


def append_rates(rated: DataFrame, path: str, batch: str = "0") -> None:
    """Adds a run's rows (run_tag, stem, cer, wer, ...) to a Parquet table, in folders by run_tag and `batch`; rates have four decimals.

    A job that is run again replaces what it wrote before under its run_tag and batch, so a repeated append doesn't double rows. Parts of one run that are
    written one after the other have batches of their own."""
    rates = {c: F.bround(c, 4) for c in ("cer", "wer") if c in rated.columns}
    out = rated.withColumns(rates | {"batch": F.lit(batch)}).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    out.partitionBy("run_tag", "batch").parquet(path)


def write_csv(rows: DataFrame, path: str, *order: Column | str) -> None:
    """One ordered CSV folder with a header. For report-sized tables."""
    rows.orderBy(*order).coalesce(1).write.mode("overwrite").csv(path, header=True)


def split_rejects(rows: DataFrame, status: str = "status") -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) rows."""
    return rows.filter(F.col(status) == "ok"), rows.filter(F.coalesce(F.col(status) != "ok", F.lit(True)))


def segment_detail(results: DataFrame, alternatives: int = 4) -> DataFrame:
    """A row for each recognised unit of (stem, ground_truth, cer, wer, units array<struct<char, conf, predictions array<struct<class, conf>>>>):
    the choice and `alternatives` more, padded with nulls; truth and rates only on the first row."""
    each = results.select("stem", "ground_truth", "cer", "wer", F.posexplode("units").alias("idx", "u"))
    first = F.col("idx") == 0
    other = [
        F.try_element_at("u.predictions", F.lit(k + 1))[field].alias(f"alt{k}_{field}") for k in range(1, alternatives + 1) for field in ("class", "conf")
    ]
    return each.select(
        "stem", "idx", "u.char", "u.conf", *other, *[F.when(first, F.col(c)).alias(c) for c in ("ground_truth", "cer", "wer")]
    )


def batch_summary(rated: DataFrame) -> DataFrame:
    """One row: images, labelled and failed ones, and mean rates of recognition and of the baseline, where known."""
    has = F.length("ground_truth") > 0
    return rated.agg(
        F.count("*").alias("n_images"), F.count_if(has).alias("n_labelled"), F.count_if(F.col("status") != "ok").alias("n_failed"),
        *[F.avg(F.when(has, F.col(c))).alias(f"mean_{c}") for c in ("cer", "wer", "base_cer", "base_wer") if c in rated.columns],
    )


def text_report(summary: DataFrame, title: str, seconds: float | None = None, settings: dict | None = None) -> str:
    """A one-row summary as lines of text: with `seconds`, those that the run took and those of an image (n_images of the summary, 1 at least); with `settings`, the run's."""
    row = summary.first().asDict()
    if seconds is not None:
        row |= {"seconds": float(seconds), "seconds_an_image": seconds / max(row.get("n_images") or 0, 1)}
    row |= settings or {}
    return "\n".join([title, "=" * len(title), *(f"{k:<16} {'-' if v is None else round(v, 2) if isinstance(v, float) else v}" for k, v in row.items())])


def number(value: Column, form: str) -> Column:
    """A number as text, and a dash for null, which formatting would cut to two letters."""
    return F.when(value.isNull(), "-").otherwise(F.format_string(form, value))


def html_report(rated: DataFrame, path: str) -> None:
    """HTML table rows as text files, one line an image, written by the tasks: escaped, with a class for the rate's band."""
    escaped = lambda c: F.replace(F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    colour = band(F.col("cer"), [(15, "good"), (40, "fair")], "poor")
    line = F.concat(
        F.lit("<tr class='"), colour, F.lit("'><td>"), escaped(F.col("stem")), F.lit("</td><td>"), escaped(F.col("ground_truth")), F.lit("</td><td>"),
        escaped(F.col("predicted_text")), F.lit("</td><td>"), number(F.col("cer"), "%.2f"), F.lit("</td></tr>"),
    )
    rated.select(line.alias("value")).write.mode("overwrite").text(path)


def html_page(title: str, body: str) -> str:
    return f"<!doctype html><meta charset='utf-8'><title>{html.escape(title)}</title><table>{body}</table>"


def grid_place(rows: DataFrame, key: str, order: str, columns: int = 10) -> DataFrame:
    """`rows` with the column and row of each on a contact sheet."""
    k = F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1
    return rows.withColumn("sheet_col", k % columns).withColumn("sheet_row", F.floor(k / columns))


def to_json_rows(rows: DataFrame, key: str) -> DataFrame:
    """(key, json) of each row."""
    return rows.select(key, F.to_json(F.struct(*rows.columns)).alias("json"))


def image_summary(rated: DataFrame) -> DataFrame:
    """The columns of an image's and of the master summary: what was read, the truth, and the rates of recognition and baseline."""
    wanted = ["image", "stem", "predicted_text", "ground_truth", "n_units", "wer", "cer", "base_text", "base_wer", "base_cer"]
    return rated.select(*[c for c in wanted if c in rated.columns])
