import numpy as np
from pyspark.sql import functions as F

from scriptorium.operators import response, search
from scriptorium.plans import flows
from scriptorium.plans import queries as plans

SMALL = flows.LineSettings(height=32, canvas=48, margin=2, window_pad=2, blob_min_area=1)


def lines(spark):
    image = np.full((32, 80), 255, np.uint8)
    for a in (10, 20, 60):
        image[4:28, a : a + 4] = 0
    rows = [("a", 32, 80, image.tobytes()), ("broken", 32, 80, b"x"), ("none", None, None, None)]
    return spark.createDataFrame(rows, "stem string, h int, w int, data binary")


def scorer(crops):
    return crops.select("stem", "seg_idx", "pair", F.when(F.col("pair"), "k").otherwise("a").alias("char"), F.lit(50.0).alias("conf"))


def test_images_to_rates(spark):
    labels = spark.createDataFrame([("a", "aa a"), ("broken", "b")], "stem string, ground_truth string")
    plain = spark.createDataFrame([("a", None)], "base string, compound string")
    base = spark.createDataFrame([("a", "a a")], "stem string, text string")
    rows = {r.stem: r for r in flows.recognise_images(lines(spark), labels, scorer, plain, SMALL, base).collect()}
    assert (rows["a"].predicted_text, rows["a"].n_segments, rows["a"].n_words, rows["a"].cer) == ("aa a", 3, 2, 0.0)
    assert rows["a"].base_cer == 25.0
    assert (rows["broken"].status, rows["broken"].cer, rows["none"].n_segments) == ("undecodable", 100.0, 0)
    merging = spark.createDataFrame([("a", "k")], "base string, compound string")
    rated = flows.recognise_images(lines(spark), labels, scorer, merging, SMALL)
    assert rated.filter("stem = 'a'").first().predicted_text == "k a"
    assert flows.summarise(rated).first().n_images == 3


def test_grid_analysis_and_inference(spark):
    labels = spark.createDataFrame([("a", "aa a")], "stem string, ground_truth string")
    edges = spark.createDataFrame([("a", None)], "base string, compound string")
    grid = {"smoothing_k": [1.0, 3.0], "close_k": [3.0]}
    fact = flows.evaluate_grid(lines(spark), labels, scorer, edges, grid, SMALL)
    rows = sorted((r.run_tag, r.smoothing_k, r.close_k, r.cer) for r in fact.collect())
    assert rows == [("run_00000", 1.0, 3.0, 0.0), ("run_00001", 3.0, 3.0, 0.0)]
    told = flows.analyse(fact, grid, "close_k")
    assert sorted(r.r for r in told["correlations"].collect()) == [0.0, 0.0]
    assert told["anchors"].count() == 1
    found = flows.infer(lines(spark), labels, scorer, edges, None, grid, {"close_k": 3.0}, SMALL)
    assert found.filter("stem = 'a'").first().cer == 0.0


def test_batches_of_a_scorer(spark):
    """A model is asked in batches, of crops with an image alone; null in, null out, and unknown classes are nulls."""
    shades = [0, 10, 20, None, 30, 40, 50]
    rows = [("a", k, k % 2 == 1, None if x is None else bytes([x] * 16)) for k, x in enumerate(shades)]
    rows = spark.createDataFrame(rows, "stem string, seg_idx int, pair boolean, glyph binary").coalesce(1)

    def predict(images):
        assert len(images) <= 4
        of = images[:, 0, 0] // 10
        return np.where(np.arange(6) == of[:, None], 5.0, 0.0)

    found = flows.batch_scorer(predict, list("vwxyz"), 4, batch=4)(rows)
    assert found.schema.simpleString() == "struct<stem:string,seg_idx:int,pair:boolean,char:string,conf:double>"
    share = round(float(np.exp(5) / (np.exp(5) + 5)) * 100, 2)
    told = [("v", share), ("w", share), ("x", share), (None, None), ("y", share), ("z", share), (None, None)]
    assert sorted(tuple(r) for r in found.collect()) == [("a", k, k % 2 == 1, *t) for k, t in enumerate(told)]
    assert flows.batch_scorer(predict, ["v"], 4)(rows.limit(0)).count() == 0


def test_segments_without_word_or_prediction(spark):
    """A segment of no word is of word 0, and one without a prediction is a gap that is counted but not read."""
    prepared = flows.prepare(lines(spark).filter("stem = 'a'"), SMALL)
    rows = [("a", 0, 10, 14, None, "valley"), ("a", 1, 20, 24, 0, "valley"), ("a", 2, 60, 64, 1, "valley")]
    segments = spark.createDataFrame(rows, "stem string, seg_idx int, x_start int, x_end int, word_index int, method string")
    edges = spark.createDataFrame([("a", None)], "base string, compound string")
    silent = lambda crops: scorer(crops).filter("seg_idx <> 1 OR pair")
    whole, part = (flows.read_segments(prepared, segments, s, edges, SMALL).first() for s in (scorer, silent))
    assert (whole.predicted_text, whole.n_words, whole.n_segments) == ("aa a", 2, 3)
    assert (part.predicted_text, part.n_words, part.n_segments) == ("a a", 2, 3)


def test_equal_probes(spark):
    """Of equal probes the first stays, and none equals its centre; equal centres have each their own."""
    at = {"smoothing_k": 9.0, "close_k": 1.0, "window_pad": 2.0, "multi_seg_threshold": 100.0}
    centres = spark.createDataFrame([(1,), (1,), (2,)], "stem int").withColumns({p: F.lit(v) for p, v in at.items()})
    pair = search.SearchSettings(diagonals=(("window_pad", "close_k"),), steps={**search.STEPS, "close_k": 0.2})
    got = search.probes(centres, pair).filter("stem = 2").orderBy("ordinal").collect()
    # the pair up is the pad alone, as so small a step leaves close_k
    assert [(r.note, r.smoothing_k, r.close_k, r.window_pad, r.multi_seg_threshold) for r in got] == [
        ("diagonal + (window_pad,close_k)", 9.0, 1.0, 6.0, 100.0), ("coord - multi_seg_threshold", 9.0, 1.0, 2.0, 99.0), ("coord - smoothing_k", 7.0, 1.0, 2.0, 100.0),
    ]
    assert search.probes(centres, pair).filter("stem = 1").count() == 6


def climb_model(stem, start, rate, steps, order, max_hops=10, min_delta=0.1):
    """One image's search in plain Python, of single parameters in `order`: its end and its log."""
    legal = {"smoothing_k": (1, 9), "close_k": (1, 9), "window_pad": (2, 40), "multi_seg_threshold": (80, 100)}

    def clamp(p, v):
        low, high = legal[p]
        v = min(max(v, low), high)
        if p in ("smoothing_k", "close_k"):
            n = max(round(v), 1)
            return float(n if n % 2 else n - 1 if abs(v - max(n - 1, 1)) <= abs(v - n - 1) else n + 1)
        return float(round(v) if p == "window_pad" else round(v, 1))

    best, best_cer, steps, log, hops = dict(start), rate(stem, start), dict(steps), [], 0
    while hops < max_hops:
        centre, seen, tried = {p: clamp(p, v) for p, v in best.items()}, [], []
        for p in order:
            for sign, mark in ((1, "+"), (-1, "-")):
                own = {**centre, p: clamp(p, best[p] + sign * steps[p])}
                if own != centre and own not in seen:
                    seen.append(own)
                    tried.append((own, f"coord {mark} {p}"))
        if not tried:
            break
        gained = False
        for own, note in tried[: max_hops - hops]:
            cer = rate(stem, own)
            took = best_cer - cer > min_delta
            if took:
                best, best_cer, gained = own, cer, True
            hops += 1
            log.append((stem, hops, *own.values(), round(cer, 4), took, note))
        if not gained:
            steps = {p: v / 2 for p, v in steps.items()}
            if steps["multi_seg_threshold"] < 0.1:
                break
    return (stem, *best.values(), best_cer, hops), log


def test_hop_log(spark, sf_dir):
    def rate(stem, at):
        off = stem % 5
        return abs(at["window_pad"] - 9 - off) + abs(at["multi_seg_threshold"] - 96 - off * 0.5) * 2 + abs(at["smoothing_k"] - 5) + abs(at["close_k"] - 3)

    stems = [r.p_partkey for r in spark.read.parquet(f"{sf_dir}/part.parquet").collect()]
    start = {p: response.upper_median(v) for p, v in response.FULL_GRID.items()}
    want = [climb_model(s, start, rate, search.STEPS, search.INFLUENCE) for s in stems]
    names = list(response.FULL_GRID)
    got = plans.QUERIES["q69_hop_log"](spark, sf_dir).select("stem", "hop_number", *names, "cer", "accepted", "note").collect()
    assert sorted(tuple(r) for r in got) == sorted(x for _, log in want for x in log)
    ends = plans.QUERIES["q38_pattern_search"](spark, sf_dir).select("stem", *names, "best_cer", "hops").collect()
    assert sorted(tuple(r) for r in ends) == sorted(end for end, _ in want)


def test_search_and_train(spark, sf_dir):
    fact = plans.fact(spark, sf_dir).filter("stem <= 12")
    statistics = fact.select("stem").distinct().withColumns({"f1": (F.col("stem") % 5).cast("double"), "f2": F.col("stem").cast("double")})
    n = statistics.count()
    found = flows.search_and_train(fact, plans.made_up_rate, response.FULL_GRID, statistics, max_hops=4)
    assert found["hops"].groupBy("stem").count().filter("count > 4").isEmpty() and found["found"].count() == found["climb"].count() == n
    assert found["statistics"].count() == n and {"f1", "continuous_gain", "window_pad"} <= set(found["statistics"].columns)
    assert found["summary"].first().n_images == n and found["profiles"].agg(F.sum("n_stems").alias("n")).first().n == n
    assert set(response.FULL_GRID) <= set(found["model"].predict(statistics).columns)
