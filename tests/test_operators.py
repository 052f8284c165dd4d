import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from scriptorium.operators import dataset, intervals, lexicon, metrics, optimise, pixels, recognise, response, search
from scriptorium.sources import readers, sinks


def profile(spark, *profiles):
    return spark.createDataFrame([(k, x, v) for k, p in enumerate(profiles) for x, v in enumerate(p)], "k int, x int, ink int")


def gaps_model(p, least):
    segs, gaps, start, x = [], [], None, 0
    while x < len(p):
        if p[x] and start is None:
            start = x
        elif not p[x] and start is not None:
            y = x
            while y < len(p) and not p[y]:
                y += 1
            if y - x >= least:
                segs.append((start, x))
                gaps.append(y - x)
                start = None
            x = y
            continue
        x += 1
    if start is not None:
        segs.append((start, len(p)))
    return segs, gaps


def test_true_gaps_and_words(spark):
    rng = random.Random(5)
    given = [[0, 1, 1, 0, 0, 1, 0, 1, 0, 0], [1, 0], [0, 0], [1]] + [[int(rng.random() < 0.5) for _ in range(rng.randint(1, 40))] for _ in range(150)]
    found = intervals.true_gaps(profile(spark, *given), "k", 2)
    rows = found.orderBy("k", "seg_idx").collect()
    for k, p in enumerate(given):
        own = [r for r in rows if r.k == k]
        segs, gaps = gaps_model(p, 2)
        assert [(r.x_start, r.x_end) for r in own] == segs
        assert [r.gap_after for r in own if r.gap_after is not None] == gaps
    words = intervals.adaptive_groups(found, "k", "seg_idx", "gap_after").filter("k = 0").orderBy("seg_idx").collect()
    assert [(w.threshold, w.word_index) for w in words] == [(2.0, 0), (2.0, 1)]


def test_closed_gaps(spark):
    rows = intervals.closed_gaps(profile(spark, [0, 0, 1, 0, 1, 0, 0]), "k").orderBy("start").collect()
    assert [r.width for r in rows] == [2, 1]


def test_merge_intervals(spark):
    rng = random.Random(1)
    given = {0: [(0, 5), (6, 8), (10, 12)]} | {k: [(a, a + rng.randint(0, 6)) for a in (rng.randint(0, 60) for _ in range(12))] for k in range(1, 40)}
    frame = spark.createDataFrame([(k, a, b) for k, v in given.items() for a, b in v], "k int, a int, b int")
    rows = intervals.merge_intervals(frame, "k", "a", "b").orderBy("k", "x_start").collect()
    assert [(r.x_start, r.x_end) for r in rows if r.k == 0] == [(0, 8), (10, 12)]
    for k, v in given.items():
        want = []
        for a, b in sorted(v):
            if want and a <= want[-1][1] + 1:
                want[-1] = (want[-1][0], max(b, want[-1][1]))
            else:
                want.append((a, b))
        assert [(r.x_start, r.x_end) for r in rows if r.k == k] == want


def test_containment_and_methods(spark):
    segs = spark.createDataFrame([(1, 0, 4), (1, 3, 9), (1, 5, 9)], "k int, x_start int, x_end int")
    words = spark.createDataFrame([(1, 0, 0, 8)], "k int, word_index int, x_start int, x_end int")
    assert [(r.x_start, r.x_end) for r in intervals.contained(segs, words, "k").collect()] == [(0, 4)]
    counts = spark.createDataFrame([(2, 2), (2, 3), (0, 1), (1, 0)], "v int, b int")
    assert [r.m for r in counts.select(intervals.choose_method(F.col("v"), F.col("b")).alias("m")).collect()] == ["valley", "blob", "blob", "valley"]


def test_thin_splits():
    ink = [5] * 10 + [0] + [5] * 10
    assert intervals.split_thin(0, 21, ink, 4, 1.3, 2, 0.05) == [(0, 10), (10, 21)]
    assert intervals.split_thin(0, 21, ink, 40, 1.3, 2, 0.05) == [(0, 21)]
    assert intervals.split_thin(0, 21, ink, 4, 1.3, 0, 0.05) == [(0, 21)]
    assert len(intervals.split_thin(0, 20000, [0] * 20000, 1, 1.3, 1, 0.0)) > 5000  # no recursion limit


def test_lexicon(spark):
    words = spark.createDataFrame([("abc",)] * 3 + [("ab",), ("axb",), ("c",)], "word string")
    cut = lexicon.segmented(words, ["ab", "a", "b", "c"])
    assert lexicon.corpus_counts(cut).first().asDict() == {"total": 6, "valid": 5, "discarded": 1, "unique_valid": 3}
    trie = lexicon.prefix_table(cut)
    nodes = {tuple(r.prefix): (r.terminal_freq, r.subtree_types) for r in trie.collect()}
    assert nodes == {(): (0, 3), ("ab",): (1, 2), ("ab", "c"): (3, 1), ("c",): (1, 1)}
    asked = spark.createDataFrame([(["a"],), (["ab"],), ([],)], "prefix array<string>")
    assert {tuple(r.prefix): r.exists for r in lexicon.prefix_exists(asked, trie).collect()} == {("a",): False, ("ab",): True, (): True}
    assert {(tuple(r.prefix), r.cluster) for r in lexicon.completions(asked, trie).collect()} == {((), "ab"), ((), "c"), (("ab",), "c")}
    found = lexicon.search(spark.createDataFrame([("abc",), ("axb",), ("zz",)], "word string"), cut)
    assert {r.word: r.freq for r in found.collect()} == {"abc": 3, "axb": 0, "zz": 0}
    assert [r.cluster for r in lexicon.top_branches(trie, 1).collect()] == ["ab"]
    assert {tuple(r.prefix): r.subtree_types for r in lexicon.walk(asked, trie).collect()} == {("a",): None, ("ab",): 2, (): 3}


def test_metrics(spark):
    images = spark.createDataFrame([("a", "abc", 3), ("b", "", 0), ("c", "x", 1)], "stem string, predicted_text string, n_segments int")
    labels = spark.createDataFrame([("a", "abd"), ("b", "q")], "stem string, ground_truth string")
    rated = metrics.with_rates(metrics.with_labels(images, labels))
    assert {r.stem: (r.cer, r.wer) for r in rated.collect()} == {"a": (33.33, 100.0), "b": (100.0, 100.0), "c": (0.0, 0.0)}
    assert metrics.macro_means(rated).first().asDict() == {"n_images": 3, "n_labelled": 2, "mean_cer": pytest.approx(66.665), "mean_wer": 100.0}
    base = metrics.with_baseline(rated, spark.createDataFrame([("a", ""), ("c", "x")], "stem string, text string"))
    assert {r.stem: r.base_cer for r in base.collect()} == {"a": 100.0, "b": None, "c": None}
    assert metrics.macro_means(rated.filter("false")).first().mean_cer is None


def test_response(spark):
    grid = {"a": [1.0, 3.0, 5.0], "b": [2.0]}
    rows = [("s", 1.0, 2.0, 10.0), ("s", 3.0, 2.0, 8.0), ("s", 5.0, 2.0, 7.0), ("t", 1.0, 2.0, None)]
    fact = spark.createDataFrame(rows, "stem string, a double, b double, cer double")
    runs = response.ranked_runs(fact, ["a", "b"])
    slopes = {r.param: r for r in response.quadratic_slopes(runs, grid).collect()}
    assert slopes["a"].slope == pytest.approx(-0.75) and slopes["a"].direction == 1 and slopes["a"].sensitivity == 0.75
    assert (slopes["b"].slope, slopes["b"].direction) == (0.0, 1)
    r = {x.param: x.r for x in response.correlations(runs, ["a", "b"]).collect()}
    assert r["b"] == 0.0 and r["a"] == pytest.approx(np.corrcoef([1, 3, 5], [10, 8, 7])[0, 1], abs=1e-4)
    ratios = {(x.a, x.b): x.ratio for x in response.slope_ratios(response.quadratic_slopes(runs, grid)).collect()}
    assert ratios == {("a", "a"): 1.0, ("b", "b"): 1.0, ("a", "b"): 0.0, ("b", "a"): 0.0}
    census = response.census(fact, ["a", "b"])
    assert [(x.a, x.frequency) for x in census.collect()] == [(5.0, 1)]
    assert [(x.stem, x.a) for x in response.anchors(fact, census, ["a", "b"], "a").collect()] == [("s", 5.0)]
    assert response.upper_median([4, 8, 12, 20]) == 12
    assert response.grid_frame(spark, response.FULL_GRID).count() == 108


def test_clamp(spark):
    rows = [(4.0, 2.0, 4.5, 98.25), (2.4, 99.0, 5.5, 120.0), (3.0, 0.0, 1.0, 79.0)]
    frame = spark.createDataFrame(rows, ", ".join(f"{p} double" for p in search.PARAMS))
    got = [tuple(r) for r in search.clamp_all(frame).collect()]
    assert got == [(3.0, 1.0, 4.0, 98.2), (3.0, 9.0, 6.0, 100.0), (3.0, 1.0, 2.0, 80.0)]
    again = search.clamp_all(search.clamp_all(frame))
    assert [tuple(r) for r in again.collect()] == got


def test_pattern_search(spark):
    def rate(rows):
        return rows.withColumn("cer", F.abs(F.col("window_pad") - 14) + F.abs(F.col("multi_seg_threshold") - 97.5) * 2)

    start = rate(spark.createDataFrame([(1, 3.0, 3.0, 12.0, 97.0), (2, 3.0, 3.0, 20.0, 95.0)], "stem int, smoothing_k double, close_k double, window_pad double, multi_seg_threshold double"))
    found = {r.stem: r for r in search.pattern_search(start, rate, max_hops=40).collect()}
    assert all(found[k].best_cer < r.cer and found[k].hops <= 40 for k, r in {r.stem: r for r in start.collect()}.items())
    few = search.pattern_search(start, rate, max_hops=3).collect()
    assert all(r.hops == 3 for r in few)
    nothing = search.pattern_search(start, lambda rows: rows.withColumn("cer", F.lit(None).cast("double")), max_hops=10).collect()
    assert all(r.hops == 10 for r in nothing)
    assert search.improvement_summary(search.pattern_search(start, rate, max_hops=40), start).first().n_improved == 2
    settings = search.settings_from({"multi_seg_threshold": -0.8, "window_pad": 0.3, "close_k": 0.1, "smoothing_k": 0.01}, {("window_pad", "smoothing_k"): 0.91})
    assert settings.influence[0] == settings.tiebreak == "multi_seg_threshold"
    assert settings.steps["smoothing_k"] == 3.0 and len(settings.diagonals) == 0 or settings.diagonals == (("smoothing_k", "window_pad"),) or settings.diagonals == (("window_pad", "smoothing_k"),)


def test_recognition(spark):
    edges = readers.variant_edges(spark, {"A": ["AB"], "C": []})
    rows = [("i", 0, 0, "A", 96.0, "AB", 95.0), ("i", 1, 0, "C", 90.0, "AB", 99.0), ("i", 2, 1, "C", 50.0, "AB", 60.0), ("i", 3, 1, "A", 97.0, "ZZ", 99.9)]
    scored = spark.createDataFrame(rows, "k string, seg_idx int, word_index int, base string, base_conf double, merged string, merged_conf double")
    found = recognise.recognised(scored, edges, "k").orderBy("idx").collect()
    assert [(r.idx, r.char, r.n_segs) for r in found] == [(0, "AB", 2), (2, "AB", 2)]
    chars = spark.createDataFrame([("i", 0, "a", 0), ("i", 1, "b", 0), ("i", 2, "c", 1)], "k string, idx int, ch string, w int")
    assert recognise.assembled(chars, "k", "idx", "ch", "w").first().asDict() == {"k": "i", "text": "ab c", "text_no_spaces": "abc", "n_words": 2}
    top = spark.createDataFrame([([1.0, 3.0, 2.0],)], "v array<float>").select(recognise.top_classes(F.col("v"), 2).alias("t")).first().t
    e = [math.exp(x) for x in (1, 3, 2)]
    assert [(t.idx, t.conf) for t in top] == [(1, pytest.approx(100 * e[1] / sum(e), abs=0.01)), (2, pytest.approx(100 * e[2] / sum(e), abs=0.01))]


def test_dataset(spark):
    fonts, classes = spark.createDataFrame([("f",), ("g",)], "font_stem string"), spark.createDataFrame([("1",), ("2",)], "class_id string")
    done = spark.createDataFrame([("1", "f")], "class_id string, font_stem string")
    assert {(r.class_id, r.font_stem) for r in dataset.work_list(fonts, classes, done).collect()} == {("1", "g"), ("2", "f"), ("2", "g")}
    tries = spark.createDataFrame([("k", n, n in (3, 4, 5, 7)) for n in range(1, 10)], "k string, n int, bad boolean")
    assert dataset.breaker(tries, "k", "n", F.col("bad"), max_run=3).agg(F.max("n")).first()[0] == 5
    assert dataset.breaker(tries, "k", "n", F.col("bad"), max_run=9).count() == 9
    assert dataset.breaker(tries, "k", "n", F.col("bad"), max_run=9, max_rate=0.5, min_attempts=7).agg(F.max("n")).first()[0] == 7
    epochs = spark.createDataFrame([("k", n, v) for n, v in enumerate([3.0, 2.0, 2.5, 2.0, 1.0])], "k string, n int, loss double")
    rows = dataset.best_so_far(epochs, "k", "n", "loss", 2).orderBy("n").collect()
    assert [r.since_best for r in rows] == [0, 0, 1, 2, 0] and [r.stopped for r in rows] == [False, False, False, True, False]
    split = dataset.tier_split(spark.range(10).withColumn("t", F.lit(1)), "t", ["id"])
    assert split.filter("split = 'train'").count() == 7
    assert dataset.sample_rows(spark.range(100), "id", 10).count() == 10
    assert dataset.sample_groups(spark.range(100).withColumn("g", F.col("id") % 10), "g", 3).count() == 30


def test_parameter_model(spark):
    rows = [(float(k), float(k % 7), 3.0 if k < 20 else 5.0, 95.0 if k % 7 < 3 else 99.0) for k in range(40)]
    frame = spark.createDataFrame(rows, "f1 double, f2 double, smoothing_k double, multi_seg_threshold double")
    grid = {"smoothing_k": [1.0, 3.0, 5.0], "multi_seg_threshold": [95.0, 97.0, 99.0]}
    model = optimise.train_parameter_model(frame, ["f1", "f2"], grid, trees=5, depth=4)
    asked = spark.createDataFrame([(2.0, 1.0), (35.0, 6.0), (None, 1.0)], "f1 double, f2 double")
    got = [(r.smoothing_k, r.multi_seg_threshold) for r in model.predict(asked).collect()]
    assert got == [(3.0, 95.0), (5.0, 99.0), (3.0, 97.0)]
    assert set(model.accuracy) == set(grid) and len(model.importance) == 2
    assert optimise.train_parameter_model(frame.limit(3), ["f1"], grid) is None
    fixed = optimise.fixed_parameters(asked, {"smoothing_k": 1.0}, grid).first()
    assert (fixed.smoothing_k, fixed.multi_seg_threshold) == (1.0, 97.0)


def test_pixels(spark):
    rng = np.random.default_rng(0)
    mask = rng.random((30, 40)) < 0.3
    boxes = pixels.components(mask)
    seen, flood = np.zeros_like(mask), []
    for y, x in zip(*np.nonzero(mask)):
        if seen[y, x]:
            continue
        stack, own = [(y, x)], []
        seen[y, x] = True
        while stack:
            a, b = stack.pop()
            own.append((a, b))
            for i in range(max(0, a - 1), min(30, a + 2)):
                for j in range(max(0, b - 1), min(40, b + 2)):
                    if mask[i, j] and not seen[i, j]:
                        seen[i, j] = True
                        stack.append((i, j))
        ys, xs = zip(*own)
        flood.append((min(xs), min(ys), max(xs) + 1, max(ys) + 1, len(own)))
    assert sorted(boxes) == sorted(flood)
    bar = np.zeros((20, 40), bool)
    bar[6:14, 5:35] = True
    line = pixels.thin(bar)
    assert 0 < line.sum() < bar.sum() / 4 and not (line & ~bar).any() and len(pixels.components(line)) == 1
    assert (pixels.close(bar, 3) >= bar).all()
    d = pixels.distance(bar)
    assert d[10, 20] == 4.0 and d[6, 20] == 1.0 and d[0, 0] == 0
    grey = np.where(bar, 20, 230).astype(np.uint8)
    assert 20 <= pixels.otsu(grey) < 230 and not pixels.dark_background(grey) and pixels.dark_background(255 - grey)
    assert pixels.crop(bar, 5, 35, 2, 64).shape == (64, 64) and pixels.crop(bar, 5, 35, 2, 16).shape == (16, 16)
    assert pixels.crop(bar, 60, 61, 0, 16) is None
    images = spark.createDataFrame([("a", 20, 40, bytearray(grey.tobytes())), ("b", 3, 3, bytearray(b"xx")), ("c", None, None, None)], "stem string, h int, w int, data binary")
    rows = {r.stem: r for r in pixels.image_statistics(images).collect()}
    assert rows["a"].status == "ok" and rows["b"].status == rows["c"].status == "undecodable" and rows["a"].n_components == 1
    done = {r.stem: r for r in pixels.preprocess(images, height=40).collect()}
    assert done["a"].h == 40 and len(done["a"].profile) == done["a"].w
    boxes = pixels.blobs(spark.createDataFrame([("a", 20, 40, bytearray(bar.astype(np.uint8).tobytes()))], "stem string, h int, w int, data binary")).collect()
    assert [(r.x_start, r.x_end, r.area) for r in boxes] == [(5, 35, 240)]


def test_files(spark, tmp_path):
    for name in ("b.PNG", "a.png", "c.txt", "0058_Basic_F_Skeleton.png", "0058_Basic_My_F.png"):
        (tmp_path / name).write_bytes(b"x")
    assert [r.stem for r in readers.image_files(spark, str(tmp_path)).orderBy("path").collect()] == ["0058_Basic_F_Skeleton", "0058_Basic_My_F", "a", "b"]
    glyphs = readers.glyph_files(spark, str(tmp_path)).filter("font_stem <> ''")
    assert [(r.class_id, r.font_stem) for r in readers.done_set(glyphs).collect()] == [("0058", "My_F")]
    csv = tmp_path / "labels.csv"
    csv.write_text('﻿a.png,"x"\n\nno comma\nb, y, z\na.png, last \n')
    assert {(r.stem, r.ground_truth) for r in readers.labels(spark, str(csv)).collect()} == {("a.png", "last"), ("b", "y, z")}
    base = tmp_path / "base.csv"
    base.write_text('file_name,text\na.b.png,"one\ntwo"\na.png,last\n')
    assert [(r.stem, r.text) for r in readers.baseline(spark, str(base)).collect()] == [("a", "last")]
    table = tmp_path / "err.csv"
    table.write_text("p,stem,cer\n1,a,5\n1,a,6\nx,b,1\n2, ,3\n")
    assert [(r.stem, r.p, r.cer) for r in readers.error_table(spark, str(table), ["p"]).collect()] == [("a", 1.0, 6.0)]
    (tmp_path / "map.json").write_text('{"0": "combo_a_1", "1": "vowel_b_2"}')
    assert {(r.idx, r.class_name) for r in readers.class_map(spark, str(tmp_path / "map.json")).collect()} == {("0", "combo_a_1"), ("1", "vowel_b_2")}


def test_sinks(spark, tmp_path):
    unit = "struct<char:string,conf:double,predictions:array<struct<class:string,conf:double>>>"
    frame = spark.createDataFrame([("s", "t", 1.0, 2.0, [("a", 9.0, [("a", 9.0), ("b", 1.0)]), ("c", 8.0, [])])], f"stem string, ground_truth string, cer double, wer double, units array<{unit}>")
    rows = sinks.segment_detail(frame).orderBy("idx").collect()
    assert rows[0].alt1_class == "b" and rows[0].alt2_class is None and rows[1].alt1_class is None and rows[1].cer is None and rows[0].cer == 1.0
    rated = spark.createDataFrame([("r1", "s", "g<", "p", 12.34567, 1.0, "ok")], "run_tag string, stem string, ground_truth string, predicted_text string, cer double, wer double, status string")
    sinks.append_rates(rated, str(tmp_path / "rates"))
    sinks.append_rates(rated, str(tmp_path / "rates"))
    assert spark.read.parquet(str(tmp_path / "rates")).count() == 2
    sinks.html_report(rated, str(tmp_path / "html"))
    assert "g&lt;" in spark.read.text(str(tmp_path / "html")).first().value
    assert "n_images" in sinks.text_report(sinks.batch_summary(rated), "Report")
    good, bad = sinks.split_rejects(rated)
    assert good.count() == 1 and bad.count() == 0


def test_pattern_search_uses_all_cores(spark):
    """A start of one partition, as a small file is, is dealt over all cores before the first sweep."""
    start = spark.range(400, numPartitions=1).select(F.col("id").alias("stem"), *[F.lit(v).alias(p) for p, v in zip(search.PARAMS, (3.0, 3.0, 8.0, 97.0), strict=True)], F.lit(50.0).alias("cer"))
    spread = []

    def rate(rows):
        spread.append(rows.rdd.getNumPartitions())
        return rows.withColumn("cer", F.abs(F.col("window_pad") - 20 - F.col("stem") % 3))

    found = search.pattern_search(start, rate)
    assert spread[0] >= spark.sparkContext.defaultParallelism  # later sweeps are dealt by their bytes
    assert found.count() == 400 and found.filter("hops <= 10 AND best_cer < 12").count() == 400
