"""Reports of runs: tables and pages written by the tasks, and short texts of aggregates that reach the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.functions.text import band
from scriptorium.sources.sinks import batch_summary, image_summary, number, segment_detail, text_report

#: The bands of a single image's rates, in percent.
PAGE_BANDS = [(30, "good"), (60, "fair")]


def escaped(text: Column) -> Column:
    """Text for HTML, quotes too; null is empty."""
    out = F.coalesce(text, F.lit(""))
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(raw), F.lit(safe))
    return out


def _rate(name: str) -> Column:
    told = number(F.col(name), "%.2f%%")
    return F.concat(F.lit(f"<span class='{name} "), F.when(F.col(name).isNull(), "none").otherwise(band(F.col(name), PAGE_BANDS, "poor")), F.lit("'>"), told, F.lit("</span>"))


def image_pages(results: DataFrame) -> DataFrame:
    """(stem, html): a page for each image of (stem, predicted_text, ground_truth, cer, wer, units array<struct<char, conf, ...>>), with a card
    for each unit. Everything from the data is escaped; null units give a page without cards, null rates a dash."""
    card = lambda u, k: F.concat(
        F.lit("<li value='"), (k + 1).cast("string"), F.lit("'>"), escaped(u["char"]), F.lit(" <small>"),
        number(u["conf"], "%.1f"), F.lit("</small></li>"),
    )
    cards = F.coalesce(F.array_join(F.transform("units", card), ""), F.lit(""))
    page = F.concat(
        F.lit("<!doctype html><meta charset='utf-8'><title>"), escaped(F.col("stem")), F.lit("</title><h1>"), escaped(F.col("stem")), F.lit("</h1><p>"),
        escaped(F.col("predicted_text")), F.lit("</p><p>"), escaped(F.col("ground_truth")), F.lit("</p><p>"), _rate("cer"), F.lit(" "), _rate("wer"),
        F.lit("</p><ol>"), cards, F.lit("</ol>"),
    )
    return results.select("stem", page.alias("html"))


def sensitivity_report(told: dict[str, DataFrame], grid: dict[str, list[float]], fixed: dict[str, float] | None = None, best: int = 20) -> str:
    """The text of what `flows.analyse` tells: the grid, the `best` combinations by mean cer, correlations, directions and slope ratios.
    Reaches the driver: `best` rows, and as many as there are parameters or pairs of them."""
    params = list(grid)
    runs = told["runs"].orderBy(F.asc_nulls_last("mean_cer"), *params).limit(best).collect()
    counted = told["runs"].agg(F.count("*").alias("n"), F.count_if(F.col("mean_cer").isNull()).alias("failed")).first()
    out = ["Parameter sensitivity", f"{counted.n} combinations, {counted.failed} without a valid run", "", "Fixed"]
    out += [f"  {k:<22} {v}" for k, v in (fixed or {}).items()]
    out += ["", "Grid", *(f"  {k:<22} {', '.join(map(str, v))}" for k, v in grid.items()), "", "Best combinations by mean error"]
    out += [f"  {k:>3}  {'-' if r.mean_cer is None else format(r.mean_cer, '.2f'):>7}  " + "  ".join(f"{p}={r[p]:g}" for p in params) for k, r in enumerate(runs, 1)]
    out += ["", "Correlation with the error"]
    out += [f"  {x.param:<22} {x.r:+.4f}  {x.verdict}" for x in sorted(told["correlations"].collect(), key=lambda x: (-abs(x.r), x.param))]
    out += ["", "Direction that lessens the error, and sensitivity"]
    out += [f"  {x.param:<22} {'up' if x.direction == 1 else 'down':<5} {x.sensitivity:.4f}" for x in sorted(told["slopes"].collect(), key=lambda x: params.index(x.param))]
    ratio = {(x.a, x.b): x.ratio for x in told["ratios"].collect()}
    out += ["", "Slope ratios (row to column)", " " * 24 + "".join(f"{p[:12]:>14}" for p in params)]
    out += [f"  {a:<22}" + "".join(f"{ratio[a, b]:>14.3f}" for b in params) for a in params]
    return "\n".join(out) + "\n"


def write_reports(results: DataFrame, folder: str, by_image: bool = False, title: str = "Batch", seconds: float | None = None, settings: dict | None = None) -> str:
    """Writes, below `folder`, segments and summary (CSV), pages (HTML, a line of text an image), and returns the batch's text.
    `results` is that of `image_pages` with status. `by_image` gives each image a folder of its own, for small batches; else the report is flat.
    Tables are written by the tasks; only the one-row summary reaches the driver. `seconds` and `settings` of the run are told in the text, if given."""

    def save(rows: DataFrame, name: str, form: str) -> None:
        out = rows.write.mode("overwrite")
        if by_image:
            out = out.partitionBy("stem")
        if form == "csv":
            out.option("header", True).csv(f"{folder}/{name}")
        elif by_image:
            out.text(f"{folder}/{name}")
        else:
            rows.select("html").write.mode("overwrite").text(f"{folder}/{name}")

    save(segment_detail(results), "segments", "csv")
    save(image_summary(results), "summary", "csv")
    pages = image_pages(results)
    save(pages.withColumn("html", F.regexp_replace("html", r"[\r\n]+", " ")), "pages", "text")
    return text_report(batch_summary(results), title, seconds, settings)
