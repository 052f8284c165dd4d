import json

import numpy as np

from scriptorium import __main__ as command
from scriptorium.operators import lexicon, pixels
from scriptorium.plans import flows, queries
from scriptorium.sources import readers, reports

RESULTS = (
    "stem string, predicted_text string, ground_truth string, cer double, wer double, status string, "
    "units array<struct<char string, conf double, predictions array<struct<class string, conf double>>>>"
)


def results(spark):
    units = [("<k>", 91.25, [("k", 91.25), ("m", 5.0)]), (None, None, None)]
    return spark.createDataFrame([("a&b", "k\nm", "'k'", 29.9, 60.0, "ok", units), ("c", None, None, None, None, "undecodable", None)], RESULTS)


def test_pages_are_escaped(spark):
    pages = {r.stem: r.html for r in reports.image_pages(results(spark)).collect()}
    assert "<h1>a&amp;b</h1>" in pages["a&b"] and "&lt;k&gt; <small>91.3</small>" in pages["a&b"] and "&#39;k&#39;" in pages["a&b"]
    assert "class='cer good'" in pages["a&b"] and "class='wer poor'" in pages["a&b"]
    assert "class='cer none'>-<" in pages["c"] and "<ol></ol>" in pages["c"]


def test_reports_are_written(spark, tmp_path):
    for by_image in (False, True):
        folder = str(tmp_path / str(by_image))
        told = reports.write_reports(results(spark), folder, by_image, "Some batch")
        assert told.startswith("Some batch") and "n_failed         1" in told
        assert spark.read.csv(f"{folder}/segments", header=True).count() == 2
        assert spark.read.csv(f"{folder}/summary", header=True).filter("stem = 'c'").count() == 1
        assert spark.read.text(f"{folder}/pages").count() == 2
    assert reports.write_reports(results(spark).limit(0), str(tmp_path / "none")).startswith("Batch")
    told = reports.write_reports(results(spark), str(tmp_path / "timed"), seconds=5, settings={"window_pad": 12})
    assert "seconds          5.0" in told and "seconds_an_image 2.5" in told and "window_pad       12" in told
    none = reports.write_reports(results(spark).limit(0), str(tmp_path / "empty"), seconds=3)
    assert "seconds_an_image 3.0" in none


def test_sensitivity_report(spark):
    grid = {"smoothing_k": [1.0, 3.0, 5.0], "close_k": [1.0, 3.0]}
    rows = [("x", a, b, None if (a, b) == (5.0, 3.0) else a + b) for a in grid["smoothing_k"] for b in grid["close_k"]]
    fact = spark.createDataFrame(rows, "stem string, smoothing_k double, close_k double, cer double")
    text = reports.sensitivity_report(flows.analyse(fact, grid, "close_k"), grid, {"height": 512})
    assert "6 combinations, 1 without a valid run" in text and "  1     2.00  smoothing_k=1  close_k=1" in text
    assert text.index("smoothing_k=1  close_k=1") < text.index("smoothing_k=5  close_k=3") and "height" in text


def test_trie_as_json(spark, tmp_path):
    words = spark.createDataFrame([("ab", 2, ["a", "b"]), ("a", 1, ["a"]), ("c", 4, ["c"]), ("x", 1, None)], "word string, n long, clusters array<string>")
    trie, path, gone = lexicon.prefix_table(words), str(tmp_path / "trie"), str(tmp_path / "gone")
    readers.save_trie_json(trie, path)
    want = sorted(map(str, trie.collect()))
    assert sorted(map(str, readers.load_trie_json(spark, path).collect())) == want
    nested = {"meta": {}, "tree": {"c": {"a": {"f": 1, "c": {"b": {"f": 2}}}, "c": {"f": 4}}}}
    (tmp_path / "one.json").write_text(json.dumps(nested))
    assert sorted(map(str, readers.load_trie_json(spark, str(tmp_path / "one.json")).collect())) == want
    assert readers.load_trie_json(spark, gone).count() == 0


def test_fonts_resume_and_defaults(spark, tmp_path):
    gone, path = str(tmp_path / "gone"), tmp_path / "fonts.csv"
    assert readers.font_selection(spark, gone).count() == 0
    path.write_text("font_path,font_stem,tier,font_type\n/f/a.ttf,a,plain,\n/f/b.ttf,b,plain,legacy\n/f/c.ttf,c,plain,\n")
    fonts = spark.createDataFrame([("a", "unicode"), ("b", "unicode")], "font_stem string, font_type string")
    found = {r.font_stem: r.font_type for r in readers.font_selection(spark, str(path), fonts).collect()}
    assert found == {"a": "unicode", "b": "legacy", "c": None}
    assert {r.font_type for r in readers.font_selection(spark, str(path)).collect()} == {None, "legacy"}
    assert readers.correlation_table(spark, gone, ["p"]).count() == 0 and readers.ratio_table(spark, gone, ["p"]).count() == 0
    (tmp_path / "ratios.csv").write_text("param,p\np,1.0\nq,x\nother,3\n")
    ratios = readers.ratio_table(spark, str(tmp_path / "ratios.csv"), ["p", "q"])
    assert {tuple(r) for r in ratios.collect()} == {("p", "p", 1.0), ("p", "q", 0.0), ("q", "p", 0.0), ("q", "q", 0.0)}


def test_glyph_batch(spark):
    image = np.full((40, 40), 255, np.uint8)
    image[10:30, 15:25] = 0
    dot = np.full((40, 40), 255, np.uint8)
    dot[20:23, 20:23] = 0
    rows = [("k", 40, 40, image.tobytes()), ("short", 40, 40, b"x"), ("dot", 40, 40, dot.tobytes()), ("null", None, None, None)]
    glyphs = spark.createDataFrame(rows, "stem string, h int, w int, data binary")
    manifest, rejects = pixels.glyph_skeletons(glyphs)
    kept = manifest.collect()
    assert [r.stem for r in kept] == ["k"] and kept[0].n_pixels == sum(kept[0].skeleton) > 0
    assert {(r.stem, r.status) for r in rejects.collect()} == {("short", "undecodable"), ("dot", "rejected"), ("null", "undecodable")}
    none, few = pixels.glyph_skeletons(glyphs.limit(0))
    assert none.count() == few.count() == 0


def test_grid_shares_what_is_read(spark):
    image = np.full((32, 80), 255, np.uint8)
    for a in (10, 20, 60):
        image[4:28, a : a + 4] = 0
    images = spark.createDataFrame([("a/1", 32, 80, image.tobytes())], "stem string, h int, w int, data binary")
    labels = spark.createDataFrame([("a/1", "aa a")], "stem string, ground_truth string")
    edges = spark.createDataFrame([("a", None)], "base string, compound string")
    seen = []

    def scorer(crops):
        seen.append(crops.select("stem").distinct().count())
        return crops.selectExpr("stem", "seg_idx", "pair", "'a' AS char", "CAST(50 AS DOUBLE) AS conf")

    grid = {"smoothing_k": [1.0, 3.0], "window_pad": [2.0, 3.0], "multi_seg_threshold": [85.0, 90.0, 95.0]}
    settings = flows.LineSettings(height=32, canvas=48, margin=2, window_pad=2, blob_min_area=1)
    found = flows.evaluate_grid(images, labels, scorer, edges, grid, settings).collect()
    assert seen == [4] and len(found) == 12 and len({r.run_tag for r in found}) == 12
    assert {(r.smoothing_k, r.window_pad, r.multi_seg_threshold) for r in found} == {(a, b, c) for a in (1, 3) for b in (2, 3) for c in (85, 90, 95)}
    assert {(r.stem, r.cer) for r in found} == {("a/1", 0.0)}


def test_command_lists_queries(capsys):
    command.main(["list"])
    assert capsys.readouterr().out.split() == sorted(queries.QUERIES)
