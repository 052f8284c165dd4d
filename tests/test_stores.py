"""Files written one after the other, repeated and broken-off runs, the stored prefix index, and the search's memory."""

import os
import shutil
import time

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from scriptorium.operators import lexicon, search
from scriptorium.plans import queries as plans
from scriptorium.sources import incremental, prefix_index, readers, shared, sinks

UNITS = ["th", "t", "h", "e", "a", "n", "d", "an"]


def put(path, text, at):
    path.write_text(text)
    os.utime(path, (at, at))


def test_last_file_counts(spark, tmp_path):
    """The later file's rows count, however large the files are."""
    now = time.time()
    filler = "".join(f"f{i},1,{i}\n" for i in range(20_000))
    for name, small, late in (("a", "z-old.csv", "a-new.csv"), ("b", "a-old.csv", "z-new.csv")):
        folder = tmp_path / name
        folder.mkdir()
        put(folder / small, "stem,k,cer\nx,1,10\n", now - 100)
        put(folder / late, "stem,k,cer\n" + filler + "x,1,20\nx,1,30\n", now)
        assert [r.cer for r in readers.error_table(spark, str(folder), ["k"]).filter("stem = 'x'").collect()] == [30.0]
        put(folder / small, "stem,k,cer\nx,1,10\n", now + 100)
        assert [r.cer for r in readers.error_table(spark, str(folder), ["k"]).filter("stem = 'x'").collect()] == [10.0]


def test_order_over_split_files(spark, tmp_path):
    path = tmp_path / "labels.csv"
    path.write_text("".join(f"s{i % 50},{i}\n" for i in range(30_000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        found = readers.labels(spark, str(path))
        assert {(r.stem, r.ground_truth) for r in found.collect()} == {(f"s{i % 50}", str(i)) for i in range(29_950, 30_000)}
        (tmp_path / "base").mkdir()
        put(tmp_path / "base" / "1.csv", "file_name,text\na.b.png,new\n", time.time())
        put(tmp_path / "base" / "2.csv", "file_name,text\na.png,old\n" + "q.png,x\n" * 5000, time.time() - 50)
        assert {(r.stem, r.text) for r in readers.baseline(spark, str(tmp_path / "base")).collect()} == {("a", "new"), ("q", "x")}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_appends_can_be_repeated(spark, tmp_path):
    rows = spark.createDataFrame([("r1", "a", 1.23456), ("r2", "b", 2.0)], "run_tag string, stem string, cer double")
    path = str(tmp_path / "rates")
    for _ in range(2):
        sinks.append_rates(rows, path)
    sinks.append_rates(rows.filter("run_tag = 'r1'").withColumn("stem", F.lit("c")), path, batch="1")
    held = spark.read.parquet(path)
    assert sorted((r.run_tag, r.stem, r.cer) for r in held.collect()) == [("r1", "a", 1.2346), ("r1", "c", 1.2346), ("r2", "b", 2.0)]


def test_broken_run_is_continued(spark, tmp_path):
    folder, table, log = tmp_path / "images", str(tmp_path / "rates"), str(tmp_path / "log")
    folder.mkdir()
    for name in ("a.png", "b.png", "note.txt"):
        (folder / name).write_bytes(name.encode())
    rate = lambda files: files.select("stem", F.length("content").cast("double").alias("cer"))
    run = lambda f: incremental.run_new_files(spark, str(folder), f, table, log, "r")
    stems = lambda: sorted(r.stem for r in spark.read.parquet(table).collect())
    real = sinks.append_rates
    try:  # killed between the write and its commit in the log
        incremental.append_rates = lambda *a, **k: (real(*a, **k), 1 / 0)
        with pytest.raises(Exception):
            run(rate)
    finally:
        incremental.append_rates = real
    assert stems() == ["a", "b"]
    assert run(rate) == 1 and stems() == ["a", "b"]
    assert run(rate) == 0
    (folder / "c.png").write_bytes(b"more")
    assert run(rate) == 1 and stems() == ["a", "b", "c"]


def test_stored_index_reads_few_row_groups(spark, sf_dir, tmp_path, monkeypatch):
    monkeypatch.setattr(prefix_index, "GROUP_BYTES", 4096)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    cut = shared.cut(lexicon.segmented(lexicon.corpus_words(docs, "text"), plans.UNITS))
    trie, path = shared.cut(lexicon.prefix_table(cut)), str(tmp_path / "index")
    prefix_index.save_index(trie, path)
    index = prefix_index.open_index(spark, path)
    assert index.count() == trie.count()
    asked = spark.createDataFrame([(["th", "e"],), (["th", "q", "q"],), (["s", "t"],)], "prefix array<string>")
    for stored, plain in ((prefix_index.walk, lexicon.walk), (prefix_index.prefix_exists, lexicon.prefix_exists), (prefix_index.completions, lexicon.completions)):
        for some in (asked, asked.union(spark.createDataFrame([([],), (["zz"],)], "prefix array<string>")), asked.limit(0)):
            assert sorted(map(str, stored(index, some).collect())) == sorted(map(str, plain(some, trie).collect()))
    monkeypatch.setattr(prefix_index, "ASKED", 1)  # joined with the whole index instead
    assert sorted(map(str, prefix_index.completions(index, asked).collect())) == sorted(map(str, lexicon.completions(asked, trie).collect()))
    wanted = {"the": ("cth", "th\x1fe"), "stem": ("cs", "s\x1ft")}
    read = total = 0
    for base, _, files in os.walk(path):
        for name in files:
            if not name.endswith(".parquet"):
                continue
            meta = pq.ParquetFile(f"{base}/{name}").metadata
            total += meta.num_row_groups
            for folder, key in wanted.values():
                if not base.endswith(f"folder={folder}"):
                    continue
                for g in range(meta.num_row_groups):
                    columns = [meta.row_group(g).column(c) for c in range(meta.num_columns)]
                    own = next(c.statistics for c in columns if c.path_in_schema == "path")
                    read += own.min <= key <= own.max
    assert 0 < read and read * 10 < total
    plan = prefix_index.nodes_at(index, asked, "path")._jdf.queryExecution().executedPlan().toString()
    assert "LeftSemi" in plan


def test_insert_equals_one_build(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    words = lambda d: lexicon.segmented(lexicon.corpus_words(d, "text"), plans.UNITS)
    path = str(tmp_path / "index")
    for part in ("doc_id % 3 = 0", "doc_id % 3 = 1", "doc_id % 3 = 2", "doc_id < 0"):
        prefix_index.insert(spark, path, words(docs.filter(part)))
    want = lexicon.prefix_table(words(docs))
    assert sorted(map(str, prefix_index.open_index(spark, path).select(*prefix_index.NAMES).collect())) == sorted(map(str, want.select(*prefix_index.NAMES).collect()))
    before = {f for f in os.listdir(path)}
    few = spark.createDataFrame([("thethe",), ("the",), ("xyz!",)], "word string")
    stamps = {f: os.stat(f"{path}/{f}").st_mtime_ns for f in before if f.startswith("folder=")}
    prefix_index.insert(spark, path, lexicon.segmented(few, plans.UNITS))
    assert {f for f, at in stamps.items() if os.stat(f"{path}/{f}").st_mtime_ns != at} == {"folder=cth", "folder=root"}
    shutil.rmtree(path)
    assert prefix_index.open_index(spark, path).isEmpty()


def test_no_point_is_scored_twice(spark):
    start = spark.createDataFrame([(k, 3.0, 3.0, 12.0, 97.0) for k in range(6)], "stem int, smoothing_k double, close_k double, window_pad double, multi_seg_threshold double")
    scored = []

    def rate(rows):
        scored.extend((r.stem, *[r[p] for p in search.PARAMS]) for r in rows.collect())
        return rows.withColumn("cer", F.abs(F.col("window_pad") - 13 - F.col("stem")) + F.abs(F.col("multi_seg_threshold") - 97.5) * 2)

    first = start.withColumn("cer", F.abs(F.col("window_pad") - 13 - F.col("stem")) + F.lit(1.0))
    found, log = search.pattern_search_log(first, rate, max_hops=40)
    starts = {(k, 3.0, 3.0, 12.0, 97.0) for k in range(6)}  # these have a rate already
    assert len(scored) == len(set(scored)) and not set(scored) & starts
    rows = log.collect()
    tried = [(r.stem, *[r[p] for p in search.PARAMS]) for r in rows]
    assert len(tried) > len(set(tried)) and set(tried) - starts == set(scored)  # a point that is tried again is logged and counted again
    hops = {r.stem: r.hops for r in found.collect()}
    assert all(max(r.hop_number for r in rows if r.stem == k) == hops[k] <= 40 for k in hops)


def test_small_readers(spark, tmp_path):
    (tmp_path / "classes.csv").write_text("class_id,category,rendered,unicode_seq\n1,combination,ab,61 62\n")
    assert [tuple(r) for r in readers.class_list(spark, str(tmp_path / "classes.csv")).collect()] == [("1", "combination", "ab", "61 62")]
    (tmp_path / "white.tsv").write_text("id\trendered\n1\t ab \n2\tab\n3\t\n4\tc\n")
    assert sorted(r.rendered for r in readers.whitelist(spark, str(tmp_path / "white.tsv")).collect()) == ["ab", "c"]
    for label in ("zeta", "alpha"):
        (tmp_path / "set" / label).mkdir(parents=True)
        (tmp_path / "set" / label / "1.png").write_bytes(b"x")
    assert sorted((r.label, r.class_idx) for r in readers.class_folders(spark, str(tmp_path / "set")).collect()) == [("alpha", 0), ("zeta", 1)]
    sinks.write_csv(spark.createDataFrame([(2, "b"), (1, "a")], "n int, s string"), str(tmp_path / "ranked"), "n")
    assert [tuple(r) for r in spark.read.csv(str(tmp_path / "ranked"), header=True).collect()] == [("1", "a"), ("2", "b")]
    fonts = spark.createDataFrame([("s", [65, 0x0D85]), ("l", [65])], "f string, cmap array<int>")
    assert {r.f: r.u for r in fonts.select("f", readers.is_unicode_font(F.col("cmap")).alias("u")).collect()} == {"s": True, "l": False}
