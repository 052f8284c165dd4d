"""Gaps and islands, adaptive grouping, interval merging, containment and method choice, per group key.

Every operator is a plan of windows and aggregates partitioned by `key`, and by blocks of it where it is long (see `scan`); none needs Python but `thin_splits`.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.operators.scan import KeyScan, Running, long_keys


def runs(profile: DataFrame, key: str, x: str = "x", ink: str = "ink", long: list | None = None) -> DataFrame:
    """(key, run, start, end, zero) of the maximal runs of zero and of non-zero columns; `end` is exclusive. `long`: see `KeyScan`."""
    marked = profile.select(key, F.col(x).alias("x"), (F.col(ink) == 0).alias("zero"))
    scan = KeyScan(marked, key, ["x"], long).running(was=Running("lag", F.col("zero")))
    scan.map(lambda d: d.withColumn("change", F.coalesce((F.col("zero") != F.col("was")).cast("int"), F.lit(0))))
    marked = scan.running(run=Running("sum", F.col("change"))).frame()
    return marked.groupBy(key, "run").agg(F.min("x").alias("start"), (F.max("x") + 1).alias("end"), F.first("zero").alias("zero"))


def true_gaps(profile: DataFrame, key: str, min_gap: int, x: str = "x", ink: str = "ink", long: list | None = None) -> DataFrame:
    """(key, seg_idx, x_start, x_end, gap_after): islands of ink between zero runs of at least `min_gap` columns.

    Narrower runs are absorbed. A leading run is not a gap; a trailing one is, if wide enough, and else
    the last segment ends with the profile. gap_after is null where no gap follows. A long key is scanned by blocks.
    """
    long = long_keys(profile, key) if long is None else long
    scan = KeyScan(runs(profile, key, x, ink, long), key, ["start"], long)
    scan.running(__seen=Running("max", (~F.col("zero")).cast("int")))
    scan.map(lambda d: d.filter("__seen = 1").withColumn("wide", F.col("zero") & (F.col("end") - F.col("start") >= min_gap)))
    found = scan.running(seg_idx=Running("sum", F.col("wide").cast("int"))).frame()
    found = found.withColumn("seg_idx", F.col("seg_idx") - F.col("wide").cast("int"))
    width = F.when(F.col("wide"), F.col("end") - F.col("start"))
    return found.groupBy(key, F.col("seg_idx").cast("int").alias("seg_idx")).agg(
        F.min(F.when(~F.col("zero"), F.col("start"))).alias("x_start"),
        F.coalesce(F.min(F.when(F.col("wide"), F.col("start"))), F.max("end")).alias("x_end"),
        F.max(width).alias("gap_after"),
    )


def adaptive_groups(segments: DataFrame, key: str, order: str, gap_after: str, long: list | None = None) -> DataFrame:
    """`segments` with `threshold` and `word_index`. The threshold is the mean of all recorded gaps plus half their sample
    deviation (0 for one gap, and no threshold without gaps); a gap that reaches it starts a new word. A long key is scanned by blocks."""
    gap = F.col(gap_after).cast("double")
    scan = KeyScan(segments, key, [order], long).totals(__mean=F.avg(gap), __spread=F.stddev_samp(gap)).running(__gap=Running("lag", gap))
    limit = F.coalesce(F.col("__mean") + 0.5 * F.coalesce("__spread", F.lit(0.0)), F.lit(0.0))
    scan.map(lambda d: d.withColumn("threshold", limit).withColumn("__new", F.coalesce((F.col("__gap") >= F.col("threshold")).cast("int"), F.lit(0))))
    out = scan.running(word_index=Running("sum", F.col("__new"))).frame()
    return out.withColumn("word_index", F.col("word_index").cast("int")).drop("__mean", "__spread", "__gap", "__new")


def merge_intervals(intervals: DataFrame, key: str, start: str, end: str, slack: int = 1, long: list | None = None) -> DataFrame:
    """(key, x_start, x_end, n) of the intervals' unions: one joins those before it if it starts at most `slack` after their greatest end.
    A long key is scanned by blocks."""
    scan = KeyScan(intervals.select(key, start, end), key, [start, end], long).running(__upto=Running("max", F.col(end), before=True))
    scan.map(lambda d: d.withColumn("__new", F.when(F.col(start) <= F.col("__upto") + slack, 0).otherwise(1)))
    marked = scan.running(finer=[-F.col("__new")], __span=Running("sum", F.col("__new"))).frame()  # of equal intervals, that which opens a span comes first
    return marked.groupBy(key, "__span").agg(F.min(start).alias("x_start"), F.max(end).alias("x_end"), F.count("*").alias("n")).drop("__span")


def within_words(segments: DataFrame, words: DataFrame, key: str, long: list | None = None) -> DataFrame:
    """`segments` (key, x_start, x_end, ...) with the word_index of the word that holds them whole; what straddles a word's edge is dropped.

    Words (key, word_index, x_start, x_end) of a key are disjoint. Words and segments are sorted together by where they start, and the last word opened
    before a segment is the only one that can hold it: one sweep, and no word meets a segment that isn't its own. Null starts lie in no word."""
    word = F.struct("word_index", F.col("x_end").alias("until"))
    opened = words.select(F.col(key), F.col("x_start").alias("__x"), F.lit(0).alias("__kind"), word.alias("__word"))
    placed = segments.withColumn("__x", F.col("x_start")).withColumn("__kind", F.lit(1))
    scan = KeyScan(placed.unionByName(opened, allowMissingColumns=True), key, ["__x", "__kind"], long).running(__in=Running("last", F.col("__word")))
    inside = (F.col("__kind") == 1) & F.col("__x").isNotNull() & (F.col("x_end") <= F.col("__in.until"))
    return scan.frame().filter(inside).select(*segments.columns, F.col("__in.word_index").alias("word_index"))


def contained(segments: DataFrame, words: DataFrame, key: str) -> DataFrame:
    """Segments (key, x_start, x_end) with the word_index, w_start and w_end of the word that holds them; see `within_words`."""
    w = words.select(key, F.struct("word_index", F.col("x_start").alias("w_start"), F.col("x_end").alias("w_end")).alias("word_index"), "x_start", "x_end")
    return within_words(segments, w, key).select(*segments.columns, "word_index.*")


def choose_method(valley: Column, blob: Column) -> Column:
    """By the counts of segments: an empty side loses, and blob wins only with strictly more."""
    return F.when(valley == 0, "blob").when(blob > valley, "blob").otherwise("valley")


def fuse_segments(valley: DataFrame, blob: DataFrame, words: DataFrame, key: str, long: list | None = None) -> DataFrame:
    """(key, seg_idx, x_start, x_end, word_index, method): for each word, the segments of the method chosen for it, numbered anew per key.
    The segments of both methods are placed in the words by one sweep (see `within_words`)."""
    told = [d.select(key, "x_start", "x_end", F.lit(m).alias("method")) for d, m in ((valley, "valley"), (blob, "blob"))]
    both = within_words(told[0].unionByName(told[1]), words, key, long)
    word = Window.partitionBy(key, "word_index")
    n = {m: F.count_if(F.col("method") == m).over(word) for m in ("valley", "blob")}
    chosen = both.withColumn("__n", choose_method(n["valley"], n["blob"])).filter("method = __n").drop("__n")
    scan = KeyScan(chosen, key, ["word_index", "x_start", "x_end"], long).running(seg_idx=Running("sum", F.lit(1)))
    return scan.frame().withColumn("seg_idx", (F.col("seg_idx") - 1).cast("int"))


def method_summary(methods: DataFrame, key: str) -> DataFrame:
    """(key, summary) such as `valley:2,blob:1`; a method that isn't used is left out."""
    parts = [
        F.when(F.count_if(F.col("method") == m) > 0, F.concat(F.lit(f"{m}:"), F.count_if(F.col("method") == m).cast("string")))
        for m in ("valley", "blob")
    ]
    return methods.groupBy(key).agg(F.concat_ws(",", *parts).alias("summary"))


def closed_gaps(profile: DataFrame, key: str, x: str = "x", ink: str = "ink", long: list | None = None) -> DataFrame:
    """(key, start, width) of zero runs that ink closes: the leading one counts and the trailing one doesn't. A long key is scanned by blocks."""
    long = long_keys(profile, key) if long is None else long
    scan = KeyScan(runs(profile, key, x, ink, long), key, ["start"], long).running(after=Running("lead", F.col("zero")))
    return scan.frame().filter("zero AND after IS NOT NULL").select(key, "start", (F.col("end") - F.col("start")).alias("width"))


def split_thin(x1: int, x2: int, ink: list[int], height: int, rect: float, margin: int, thin: float) -> list[tuple[int, int]]:
    """A segment split at thin columns while it is wide for its height; ink[k] is column k's. An explicit stack, so any width will do."""
    out, stack = [], [(x1, x2)]
    while stack:
        a, b = stack.pop()
        inner = ink[a + margin : b - margin] if margin > 0 else []
        if b - a < height * rect or b - a < 2 * margin or not inner or min(inner) > height * thin:
            out.append((a, b))
            continue
        low = min(inner)
        ties = [k for k, v in enumerate(inner) if v == low]
        at = a + margin + ties[len(ties) // 2]
        stack += [(at, b), (a, at)]
    return out


def thin_splits(
    segments: DataFrame, profiles: DataFrame, key: str, height: int, rect: float = 1.3, margin: int = 12, thin: float = 0.05
) -> DataFrame:
    """(key, seg_idx, part, x_start, x_end): each segment split at thin valleys. profiles: (key, ink array). Each split depends
    on the one before, so this is a Python function over Arrow batches; a profile is one row."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in frames:
            out = [
                (k, s, n, a, b)
                for k, s, x1, x2, ink in zip(rows[key], rows["seg_idx"], rows["x_start"], rows["x_end"], rows["ink"], strict=True)
                for n, (a, b) in enumerate(split_thin(int(x1), int(x2), list(ink), height, rect, margin, thin))
            ]
            yield pd.DataFrame(out, columns=[key, "seg_idx", "part", "x_start", "x_end"])

    kind = segments.schema[key].dataType.simpleString()
    joined = segments.select(key, "seg_idx", "x_start", "x_end").join(profiles.select(key, "ink"), key)
    return joined.mapInPandas(run, f"`{key}` {kind}, seg_idx int, part int, x_start int, x_end int")
