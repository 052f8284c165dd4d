"""Block-wise scans against windows, plain Python and SQL, with keys that are long."""

import random
from collections import Counter

import pytest
from helpers import assert_same
from pyspark.sql import functions as F

from scriptorium.operators import dataset, intervals, scan
from scriptorium.operators.scan import KeyScan, Running
from scriptorium.plans import queries as plans


def every_kind():
    v, s = F.col("v"), F.col("s")
    return {
        "total": Running("sum", v), "prior": Running("sum", v, before=True), "most": Running("max", v), "least": Running("min", v, before=True), "name": Running("last", s),
        "name_before": Running("last", s, before=True), "previous": Running("lag", v), "following": Running("lead", s), "n": Running("sum", F.lit(1)),
    }


def rows_of(rng, n):
    keys = ["hot"] * 6 + [None] * 3 + ["a", "b"]
    return [(rng.choice(keys), i, rng.choice([None, *range(9)]), rng.choice([None, None, "x", "y"])) for i in range(n)]


def test_scan_by_blocks_equals_windows(spark):
    rng = random.Random(4)
    df = spark.createDataFrame(rows_of(rng, 1500), "k string, at int, v int, s string").repartition(7)
    assert sorted(scan.long_keys(df, "k", 100), key=str) == ["None", "a", "b", "hot"] or None in scan.long_keys(df, "k", 100)
    names = ["k", "at", *every_kind()]
    plain = KeyScan(df, "k", ["at"], []).running(**every_kind()).totals(mean=F.avg("v")).frame().select(*names, "mean")
    for long in ([None, "hot"], ["hot", "none such"], ["hot", None, "a", "b"]):
        blocks = KeyScan(df, "k", ["at"], long).running(**every_kind()).totals(mean=F.avg("v")).frame().select(*names, "mean")
        assert sorted(map(str, blocks.collect())) == sorted(map(str, plain.collect()))


def test_scans_follow_each_other(spark):
    rng = random.Random(5)
    df = spark.createDataFrame(rows_of(rng, 700), "k string, at int, v int, s string")

    def run(long):
        found = KeyScan(df, "k", ["at"], long).running(was=Running("lag", F.col("s")))
        found.map(lambda d: d.withColumn("new", F.when(F.col("s").eqNullSafe(F.col("was")), 0).otherwise(1)))
        return sorted(map(str, found.running(group=Running("sum", F.col("new"))).frame().select("k", "at", "group").collect()))

    assert run([]) == run(["hot", None])


def test_long_keys(spark):
    df = spark.createDataFrame([(k % 3 if k < 900 else 1000 + k,) for k in range(1000)], "k int")
    assert sorted(scan.long_keys(df, "k", 10)) == [0, 1, 2] and scan.long_keys(df, "k") == [] and scan.long_keys(df.limit(0), "k") == []
    assert scan.long_keys(df.select(F.lit(None).cast("int").alias("k")), "k", 10) == [None]


@pytest.fixture
def all_long(monkeypatch):
    monkeypatch.setattr(scan, "LONG_ROWS", 4)
    monkeypatch.setattr(scan, "SHARE", 10**6)


@pytest.mark.parametrize("name", ["q10_true_gaps", "q11_adaptive_groups", "q12_interval_merge", "q13_containment", "q14_method_choice", "q15_gap_stats", "q53_breaker", "q56_best_so_far"])
def test_queries_by_blocks(spark, sf_dir, all_long, name):
    assert_same(plans.QUERIES[name](spark, sf_dir), plans.ORACLES[name], sf_dir)


def test_all_spans_under_one_key(spark, sf_dir):
    """No task has over twice the median's rows, and the unions are those of a plain sweep."""
    spans = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.lit(1).alias("k"), F.datediff("l_shipdate", F.lit("1992-01-01")).alias("a"), F.col("l_partkey").alias("p"))
    spans = spans.select("k", (F.col("a") * 50 + F.col("p") % 7).alias("a"), (F.col("a") * 50 + F.col("p") % 60).alias("b")).filter("a <= b")
    want, most = [], None
    for r in sorted(spans.collect(), key=lambda r: (r.a, r.b)):
        if most is not None and r.a <= most + 1:
            most = max(most, r.b)
            want[-1] = (want[-1][0], most, want[-1][2] + 1)
        else:
            most = r.b
            want.append((r.a, r.b, 1))
    found = intervals.merge_intervals(spans, "k", "a", "b", long=[1]).collect()
    assert sorted((r.x_start, r.x_end, r.n) for r in found) == want
    held = KeyScan(spans, "k", ["a", "b"], [1]).running(upto=Running("max", F.col("b"))).frame()
    sizes = sorted(r["count"] for r in held.groupBy(F.spark_partition_id()).count().collect())
    assert len(sizes) == 4 and sizes[-1] <= 2 * sizes[len(sizes) // 2]


def test_words_and_segments_on_one_key(spark):
    rng = random.Random(9)
    ends = sorted(rng.sample(range(40_000), 4000))
    words = [("k", i, a, b) for i, (a, b) in enumerate(zip(ends[::2], ends[1::2]))]
    segs = [("k", s, s + rng.randrange(1, 9)) for s in (rng.randrange(40_000) for _ in range(3000))] + [("z", 1, 2), ("k", None, 5), ("k", 5, None)]
    want = Counter((s, e, i) for _, s, e in segs if s is not None and e is not None and _ == "k" for _, i, a, b in words if a <= s and e <= b)
    words = spark.createDataFrame(words, "k string, word_index int, x_start int, x_end int")
    segs = spark.createDataFrame(segs, "k string, x_start int, x_end int")
    for long in ([], ["k"]):
        found = intervals.within_words(segs, words, "k", long).collect()
        assert Counter((r.x_start, r.x_end, r.word_index) for r in found) == want


def quotas(rows, share, least):
    held = {}
    for r in sorted(rows, key=lambda r: (r[1] is not None, r[1] if r[1] is not None else 0, r[2])):
        held.setdefault(r[0], []).append(r)
    return {r for own in held.values() for r in own[: max(least, int(share * len(own)))]}


@pytest.mark.parametrize("spread", [1, 3, 10**6])
def test_quota_cut(spark, monkeypatch, spread):
    monkeypatch.setattr(scan, "LONG_ROWS", 50)
    rng = random.Random(spread)
    rows = [(rng.choice(["big", "big", "big", "small", None]), rng.choice([None, *[rng.randrange(spread)] * 9]), i) for i in range(900)] + [("one", 5, 900)]
    df = spark.createDataFrame(rows, "t string, v int, i int")
    for share, bins in ((0.7, 4096), (0.013, 3)):
        got = scan.quota_cut(df, ["t"], ["v", "i"], lambda n: F.greatest(F.lit(1), F.floor(F.lit(share) * n)), bins=bins)
        assert got.columns == ["t", "v", "i", "within"] and got.count() == len(rows)
        assert {(r.t, r.v, r.i) for r in got.filter("within").collect()} == quotas(rows, share, 1)
    none = scan.quota_cut(df, ["t"], ["v", "i"], lambda n: F.lit(0))
    assert none.count() == len(rows) and none.filter("within").isEmpty()
    assert scan.quota_cut(df.limit(0), ["t"], ["v", "i"], lambda n: n).isEmpty()


def test_splits_need_no_window_over_a_stratum(spark):
    """The only windows are over bins, and over the rows of the one bin where the quota ends."""
    df = spark.range(20_000).select((F.col("id") % 2).alias("t"), F.xxhash64("id").alias("v"), "id")
    found = dataset.tier_split(df, "t", ["v", "id"])
    assert found.groupBy("t").agg(F.count_if(F.col("split") == "train").alias("n")).filter("n = 7000").count() == 2
    ranked = scan.quota_cut(df, ["t"], ["v", "id"], lambda n: F.floor(n * 0.7)).filter("within")
    plain = sorted((r.v, r.id) for r in df.filter("t = 1").collect())[:7000]
    assert sorted((r.v, r.id) for r in ranked.filter("t = 1").collect()) == plain


def test_numbered(spark):
    rng = random.Random(2)
    rows = [(rng.randrange(50), i) for i in range(1000)]
    df = spark.createDataFrame(rows, "v int, i int").repartition(6)
    got = {(r.v, r.i): r.k for r in scan.numbered(df, F.desc("v"), "i").collect()}
    assert got == {r: k for k, r in enumerate(sorted(rows, key=lambda r: (-r[0], r[1])), 1)}
    assert scan.numbered(df.limit(0), "v").isEmpty()


def test_moving_mean_over_stretches(spark, monkeypatch):
    monkeypatch.setattr(dataset, "STRETCH", 7)
    rng = random.Random(3)
    losses = [rng.choice([None, rng.random()]) if i % 5 else rng.random() for i in range(60)]
    df = spark.createDataFrame([("k", i, x) for i, x in enumerate(losses)], "k string, t int, loss double")
    for long in ([], ["k"]):
        for r in dataset.best_so_far(df, "k", "t", "loss", long=long).collect():
            held = [x for x in losses[max(0, r.t - 4) : r.t + 1] if x is not None]
            assert abs(r.ma5 - sum(held) / len(held)) < 1e-12
