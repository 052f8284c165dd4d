"""Whole runs composed of the operators: text from images of lines, grids of parameters and their analysis, and inference with
parameters of each image's own.

Images are rows (stem, h, w, data). A scorer is a function given by the caller, from crops (stem, seg_idx, pair, glyph) to
(stem, seg_idx, pair, char, conf), so any model can be put in, by a Pandas UDF, say. Parameters may be columns of the images.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.operators import intervals, metrics, pixels, recognise, response, search
from scriptorium.operators.optimise import ParameterModel, fixed_parameters, train_parameter_model
from scriptorium.sources.shared import cut
from scriptorium.sources.sinks import batch_summary

Scorer = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class LineSettings:
    """The tunables and what they are without tuning. The first three may also be columns of the images."""

    smoothing_k: float = 3
    close_k: float = 3
    window_pad: float = 12
    height: int = 512
    dilations: int = 1
    min_gap: int = 2
    blob_min_area: int = 15
    rect: float = 1.3
    thin: float = 0.05
    margin: int = 12
    canvas: int = 384
    spacer: bool = True


BY_IMAGE = ("smoothing_k", "close_k", "window_pad")


def prepare(images: DataFrame, settings: LineSettings) -> DataFrame:
    """(stem, h, w, skeleton, profile, window_pad, status) of each image; status is 'ok', or 'undecodable' with nulls."""
    own = {p: F.coalesce(F.col(p).cast("double"), F.lit(float(getattr(settings, p)))) if p in images.columns else F.lit(float(getattr(settings, p))) for p in BY_IMAGE}

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in frames:
            out = []
            for row in rows.itertuples(index=False):
                image = pixels.as_image(None if pd.isna(row.h) else int(row.h), None if pd.isna(row.w) else int(row.w), row.data)
                if image is None:
                    out.append((row.stem, None, None, None, None, int(row.window_pad), "undecodable"))
                    continue
                lines = pixels.skeleton(pixels.binarise(image, settings.height, int(row.smoothing_k)), int(row.close_k), settings.dilations)
                out.append((row.stem, *lines.shape, lines.astype(np.uint8).tobytes(), lines.sum(0).tolist(), int(row.window_pad), "ok"))
            yield pd.DataFrame(out, columns=["stem", "h", "w", "skeleton", "profile", "window_pad", "status"]).astype({"h": "Int32", "w": "Int32"})

    read = images.select("stem", "h", "w", "data", *[c.alias(p) for p, c in own.items()])
    return read.mapInPandas(run, "stem string, h int, w int, skeleton binary, profile array<int>, window_pad int, status string")


def segment(prepared: DataFrame, settings: LineSettings) -> DataFrame:
    """(stem, seg_idx, x_start, x_end, word_index, method): valleys and blobs, the one or the other by word. Without the spacer an image is one word."""
    good = prepared.filter("status = 'ok'")
    islands = intervals.true_gaps(good.select("stem", F.posexplode("profile").alias("x", "ink")), "stem", settings.min_gap)
    grouped = intervals.adaptive_groups(islands, "stem", "seg_idx", "gap_after") if settings.spacer else islands.withColumn("word_index", F.lit(0))
    words = grouped.groupBy("stem", "word_index").agg(F.min("x_start").alias("x_start"), F.max("x_end").alias("x_end"))
    profiles = good.select("stem", F.col("profile").alias("ink"))
    valley = intervals.thin_splits(islands, profiles, "stem", settings.height, settings.rect, settings.margin, settings.thin)
    boxes = pixels.blobs(good.select("stem", "h", "w", F.col("skeleton").alias("data")), settings.blob_min_area)
    return intervals.fuse_segments(valley, intervals.merge_intervals(boxes, "stem", "x_start", "x_end"), words, "stem")


def crops(prepared: DataFrame, segments: DataFrame, settings: LineSettings) -> DataFrame:
    """(stem, seg_idx, pair, glyph): each segment's window on a square canvas, and, as `pair`, that of the segment with its right
    neighbour in the word. An image's crops are made together, and glyph is null for a window without pixels."""
    place = Window.partitionBy("stem").orderBy("seg_idx")
    joined_end = F.when(F.lead("word_index").over(place) == F.col("word_index"), F.lead("x_end").over(place))
    each = segments.select("stem", "seg_idx", "x_start", "x_end", joined_end.alias("pair_end"))
    windows = each.groupBy("stem").agg(F.array_sort(F.collect_list(F.struct("seg_idx", "x_start", "x_end", "pair_end"))).alias("windows"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in frames:
            for row in rows.itertuples(index=False):
                lines, out = pixels.as_image(int(row.h), int(row.w), row.skeleton), []
                for x in row.windows:
                    for pair, end in ((False, x["x_end"]), (True, x["pair_end"])):
                        if not pd.isna(end):
                            glyph = pixels.crop(lines > 0, int(x["x_start"]), int(end), int(row.window_pad), settings.canvas)
                            out.append((row.stem, int(x["seg_idx"]), pair, None if glyph is None else glyph.tobytes()))
                yield pd.DataFrame(out, columns=["stem", "seg_idx", "pair", "glyph"])

    joined = prepared.select("stem", "h", "w", "skeleton", "window_pad").join(windows, "stem")
    return joined.mapInPandas(run, "stem string, seg_idx int, pair boolean, glyph binary")


def batch_scorer(predict: Callable[[np.ndarray], np.ndarray], names: list[str], canvas: int = LineSettings.canvas, batch: int = 64) -> Scorer:
    """A scorer of a function from images (n, canvas, canvas), numbers from 0 to 255, to logits (n, classes), called with `batch` images at most.

    The likeliest class is told by its name in `names` and in percent with two decimals, the lower number where equal. A crop without an image has no prediction: null in, null out; and a class
    beyond `names` has none either. An order of crops isn't assumed, so batches may be cut anywhere."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in frames:
            chars, confs = np.full(len(rows), None, object), np.full(len(rows), np.nan)
            able = np.flatnonzero(rows["glyph"].notna().to_numpy())
            for at in range(0, len(able), batch):
                own = able[at : at + batch]
                images = np.stack([np.frombuffer(x, np.uint8).reshape(canvas, canvas) for x in rows["glyph"].iloc[own]])
                logits = np.asarray(predict(images), float)
                shares = np.exp(logits - logits.max(1, keepdims=True))
                shares /= shares.sum(1, keepdims=True)
                for k, best in zip(own, shares.argmax(1), strict=True):
                    if best < len(names):
                        chars[k] = names[best]
                confs[own] = np.where(shares.argmax(1) < len(names), np.round(shares.max(1) * 100, 2), np.nan)
            told = pd.Series(confs).astype("Float64").where(~np.isnan(confs), pd.NA)
            yield pd.DataFrame({"stem": rows["stem"].to_numpy(), "seg_idx": rows["seg_idx"].to_numpy(), "pair": rows["pair"].to_numpy(), "char": chars, "conf": told})

    return lambda crops: crops.select("stem", "seg_idx", "pair", "glyph").mapInPandas(run, "stem string, seg_idx int, pair boolean, char string, conf double")


def read_lines(images: DataFrame, scorer: Scorer, edges: DataFrame, settings: LineSettings | None = None) -> DataFrame:
    """(stem, predicted_text, n_segments, n_words, status) of each image. edges: (base, compound), as of `recognise.validated`.

    The pixel work and the segments are computed once and kept in the shared folder, as several branches of the plan read them.
    """
    settings = settings or LineSettings()
    prepared = cut(prepare(images, settings))
    return read_segments(prepared, cut(segment(prepared, settings)), scorer, edges, settings)


def read_segments(prepared: DataFrame, segments: DataFrame, scorer: Scorer, edges: DataFrame, settings: LineSettings) -> DataFrame:
    """What `read_lines` returns, of images that are prepared and segmented."""
    told = F.struct("char", "conf")
    scored = scorer(crops(prepared, segments, settings)).groupBy("stem", "seg_idx").agg(
        F.max(F.when(~F.col("pair"), told)).alias("own"), F.max(F.when(F.col("pair"), told)).alias("both")
    )
    # a segment that the scorer tells nothing of is a gap, and one without a word is of word 0
    words = segments.select("stem", "seg_idx", F.coalesce("word_index", F.lit(0)).alias("word_index"))
    each = words.join(scored, ["stem", "seg_idx"], "left").select(
        "stem", "seg_idx", "word_index", F.col("own.char").alias("base"), F.col("own.conf").alias("base_conf"),
        F.col("both.char").alias("merged"), F.col("both.conf").alias("merged_conf"),
    )
    found = recognise.recognised(each, edges, "stem").join(words.withColumnRenamed("seg_idx", "idx"), ["stem", "idx"])
    texts = recognise.assembled(found, "stem", "idx", "char", "word_index")
    counted = segments.groupBy("stem").agg(F.count("*").alias("n_segments"))
    return prepared.select("stem", "status").join(texts, "stem", "left").join(counted, "stem", "left").select(
        "stem", F.coalesce("text", F.lit("")).alias("predicted_text"), F.coalesce("n_segments", F.lit(0)).alias("n_segments"),
        F.coalesce("n_words", F.lit(0)).alias("n_words"), "status",
    )


def recognise_images(
    images: DataFrame, labels: DataFrame, scorer: Scorer, edges: DataFrame, settings: LineSettings | None = None, baseline: DataFrame | None = None
) -> DataFrame:
    """`read_lines` with ground_truth, cer and wer, and, given a baseline (stem, text), its text and rates."""
    rated = metrics.with_rates(metrics.with_labels(read_lines(images, scorer, edges, settings), labels))
    return rated if baseline is None else metrics.with_baseline(rated, baseline)


def summarise(rated: DataFrame) -> DataFrame:
    """One row: counts, and mean rates over the labelled images."""
    return batch_summary(rated)


def evaluate_grid(
    images: DataFrame, labels: DataFrame, scorer: Scorer, edges: DataFrame, grid: dict[str, list[float]], settings: LineSettings | None = None
) -> DataFrame:
    """(stem, run_tag, parameters, cer, wer): every image with every combination of `grid`, in one plan. An image is prepared once
    for each pair of smoothing_k and close_k, and read once for each of these with each window_pad; the other parameters repeat what was read; a labelled image that can't be read has null rates."""
    settings = settings or LineSettings()
    combos = response.grid_frame(images.sparkSession, grid).collect()
    pads = sorted({int(c["window_pad"]) if "window_pad" in grid else int(settings.window_pad) for c in combos})
    pixel = [p for p in ("smoothing_k", "close_k") if p in grid]
    looks = sorted({tuple(float(c[p]) for p in pixel) for c in combos})
    options = F.array(*[
        F.struct(
            F.lit(c.run_tag).alias("run_tag"), F.lit(looks.index(tuple(float(c[p]) for p in pixel))).alias("look"),
            F.lit(pads.index(int(c["window_pad"])) if "window_pad" in grid else 0).alias("pad"), *[F.lit(float(c[p])).alias(p) for p in grid],
        )
        for c in combos
    ])
    # pixels and segments once for each way to look at an image, and reading once for each width of its windows
    views = F.array(*[F.struct(F.lit(k).alias("k"), *[F.lit(x).alias(p) for p, x in zip(pixel, look, strict=True)]) for k, look in enumerate(looks)])
    swept = images.select("stem", "h", "w", "data", F.explode(views).alias("v")).select(
        F.concat_ws("/", "v.k", "stem").alias("stem"), "h", "w", "data", *[f"v.{p}" for p in pixel]
    )
    prepared = cut(prepare(swept, settings))
    segments = cut(segment(prepared, settings))
    widths = F.posexplode(F.array(*map(F.lit, pads))).alias("__pad", "__width")
    wide = lambda df: df.select("*", widths).withColumn("stem", F.concat_ws("/", "__pad", "stem"))
    padded = wide(prepared).withColumn("window_pad", F.col("__width")).drop("__pad", "__width")
    found = read_segments(padded, wide(segments).drop("__pad", "__width"), scorer, edges, settings)
    place = F.split("stem", "/", 3)
    found = found.select(
        "*", F.get(place, 0).cast("int").alias("__pad"), F.get(place, 1).cast("int").alias("__look"), F.get(place, 2).alias("__stem")
    ).withColumn("stem", F.col("__stem"))
    rated = metrics.with_rates(metrics.with_labels(found, labels)).filter(metrics.labelled(F.col("ground_truth")))
    ok = lambda c: F.when(F.col("status") == "ok", F.col(c)).alias(c)
    mine = F.filter(options, lambda o: (o["look"] == F.col("__look")) & (o["pad"] == F.col("__pad")))
    return rated.select("stem", ok("cer"), ok("wer"), F.explode(mine).alias("o")).select("stem", "o.run_tag", *[f"o.{p}" for p in grid], "cer", "wer")


def analyse(fact: DataFrame, grid: dict[str, list[float]], tiebreak: str) -> dict[str, DataFrame]:
    """What a grid's fact table tells: ranked runs, correlations, slopes and their ratios, census of best combinations, and anchors by image."""
    params = list(grid)
    runs = response.ranked_runs(fact, params)
    slopes = response.quadratic_slopes(runs, grid)
    counted = response.census(fact, params)
    return {
        "runs": runs, "correlations": response.correlations(runs, params), "slopes": slopes, "ratios": response.slope_ratios(slopes),
        "census": counted, "anchors": response.anchors(fact, counted, params, tiebreak),
    }


def infer(
    images: DataFrame, labels: DataFrame, scorer: Scorer, edges: DataFrame, model: ParameterModel | None, grid: dict[str, list[float]],
    best: dict[str, float] | None = None, settings: LineSettings | None = None, baseline: DataFrame | None = None,
) -> DataFrame:
    """`recognise_images` with parameters for each image: the model's from its statistics, or the fixed ones of `best` without a model."""
    known = model.predict(pixels.image_statistics(images)) if model else fixed_parameters(images, best, grid)
    adapted = images.select("stem", "h", "w", "data").join(known.select("stem", *grid), "stem", "left")
    return recognise_images(adapted, labels, scorer, edges, settings, baseline)


def settings_of(known: dict[str, DataFrame]) -> search.SearchSettings:
    """A search's settings from what `analyse` tells: a row for each parameter, and for each pair of them, reach the driver."""
    r = {x.param: x.r for x in known["correlations"].collect()}
    return search.settings_from(r, {(x.a, x.b): x.ratio for x in known["ratios"].collect()})


def search_and_train(
    fact: DataFrame, score: Callable[[DataFrame], DataFrame], grid: dict[str, list[float]], statistics: DataFrame | None = None,
    features: list[str] | None = None, max_hops: int = 10, min_delta: float = 0.1,
) -> dict:
    """The run from a grid's fact table (stem, parameters, cer) to a parameter model: the grid's analysis gives the search its settings and each
    image its anchor; all images climb together from there; then the model learns the best parameters from the images'
    `statistics` (stem, `features`), if given. Returns found, hops (the log), climb, summary, profiles, model and statistics (an image's with its climb, a row each)."""
    tiebreak = "multi_seg_threshold"
    settings = settings_of(analyse(fact, grid, tiebreak))
    start = cut(response.anchors(fact, response.census(fact, list(grid)), list(grid), settings.tiebreak or tiebreak))
    found, hops = search.pattern_search_log(start, score, settings, max_hops, min_delta)
    out = {
        "found": found, "hops": hops, "climb": search.climb_summary(found, start), "summary": search.improvement_summary(found, start, min_delta),
        "profiles": response.profiles(found, list(grid)), "model": None, "statistics": None,
    }
    if statistics is not None:
        out["statistics"] = statistics.join(out["climb"], "stem")
        out["model"] = train_parameter_model(statistics.join(found, "stem"), features or [c for c in statistics.columns if c != "stem"], grid)
    return out
