import random
import zlib

import numpy as np
import pytest
from helpers import assert_same
from pyspark.sql import functions as F

from scriptorium.llm import queries, topk, toxicity, url_rules


def toxic_corpus(n=1500, seed=2):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(800)]
    bad = ["slurone", "slurtwo", "slurthree"]
    docs, labels = [], []
    for k in range(n):
        toxic = rng.random() < 0.15
        own = [rng.choice(words) for _ in range(rng.randint(5, 80))]
        if toxic:
            for _ in range(rng.randint(1, 4)):
                own.insert(rng.randrange(len(own)), rng.choice(bad))
        docs.append((k, " ".join(own)))
        if rng.random() < 0.6:
            labels.append((k, int(toxic)))
    return docs, labels, {k for k, t in docs if "slur" in t}


def test_toxicity(spark):
    docs, labels, toxic = toxic_corpus()
    extra = [(5000, None), (5001, ""), (None, "slurone slurtwo"), (5002, "word " * 200_000)]
    frame = spark.createDataFrame([(k, t, "c", 9) for k, t in docs + extra], "doc_id long, text string, score string, lang int")
    known = spark.createDataFrame([(k, t, "c") for k, t in labels] + [(labels[0][0], labels[0][1], "again"), (3, None, "c"), (None, 1, "c")], "doc_id long, toxic int, text string")
    model = toxicity.fit_toxicity(frame, known)
    rows = toxicity.score_toxicity(frame, model).collect()
    assert len(rows) == len(docs) + len(extra) and all(0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.doc_id is not None and r.doc_id < 5000 and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    hit = [r for r in held if r.predicted == 1]
    assert len([r for r in hit if r.doc_id in toxic]) >= 0.9 * len([r for r in held if r.doc_id in toxic])
    assert all(r.doc_id in toxic for r in hit)
    by_id = {r.doc_id: r for r in rows}
    assert by_id[5000].score == by_id[5001].score < 0.5 and by_id[None].predicted == 1
    flags = frame.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("h")).collect()
    assert all(f.h == (f.doc_id is not None and zlib.crc32(str(f.doc_id).encode()) % 5 == 0) for f in flags)
    # held-out labels don't change the model
    changed = known.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert toxicity.fit_toxicity(frame, changed) == model
    for d, l in ((frame.limit(0), known), (frame, known.limit(0)), (frame.limit(0), known.limit(0))):
        own = toxicity.fit_toxicity(d, l)
        assert all(r.score < 0.5 for r in toxicity.score_toxicity(frame, own).collect()) and toxicity.score_toxicity(frame.limit(0), own).count() == 0


def test_non_negative_risk():
    """The unlabelled hold positives too; the model still tells the classes apart."""
    rng = np.random.default_rng(0)
    truth = rng.random(3000) < 0.2
    toxic = np.concatenate([np.ones(400, bool), truth])
    bits = np.zeros((3400, 64), np.uint8)
    for row, bad in zip(bits, toxic):
        row[rng.choice(np.arange(8, 64), 12, replace=False)] = 1
        if bad:
            row[rng.choice(8, 2, replace=False)] = 1
    weights, bias = toxicity.train_nnpu(np.packbits(bits, axis=1), np.arange(3400) < 400, truth.mean())
    z = bits[400:] @ weights
    own = toxicity.least_risk_bias(bits[:400] @ weights, z, truth.mean(), bias)
    assert ((z + own > 0)[truth]).mean() > 0.95 and ((z + own > 0)[~truth]).mean() < 0.01
    assert weights[:8].min() > weights[8:].max()


def test_slopes_of_the_risk():
    """The slopes against numeric differences: of the risk, and of the part that has fallen below 0 the other way."""
    rng = np.random.default_rng(6)
    seen = set()
    for shift in (-4.0, 0.0, 2.0):
        z, k, prior = rng.normal(size=40) + shift * (np.arange(40) >= 15), 15, 0.4

        def excess(z, k=k, prior=prior):
            as_negative = np.logaddexp(0, z)
            return as_negative[k:].mean() - prior * as_negative[:k].mean()

        risk, slope = toxicity.nnpu_risk(z, k, prior)
        below = excess(z) < 0
        seen.add(bool(below))
        assert np.isclose(risk, prior * np.logaddexp(0, -z[:k]).mean() + max(0.0, excess(z)))
        for i in range(40):
            step = np.eye(40)[i] * 1e-6
            change = -(excess(z + step) - excess(z - step)) if below else toxicity.nnpu_risk(z + step, k, prior)[0] - toxicity.nnpu_risk(z - step, k, prior)[0]
            assert abs(change / 2e-6 - slope[i]) < 1e-6
    assert seen == {False, True}


def test_least_risk_bias():
    positive, unlabelled = np.array([5.0, 4.0, 3.0]), np.array([4.5, 3.5, 1.0, 0.5, 0.0, -1.0, -1.0, -2.0, -3.0, -4.0])
    assert toxicity.least_risk_bias(positive, unlabelled, 0.2, 9.0) == -2.0
    assert toxicity.least_risk_bias(np.zeros(0), unlabelled, 0.2, 9.0) == 9.0
    assert toxicity.least_risk_bias(np.zeros(3), np.zeros(9), 0.2, -0.25) == -0.25


def test_dense_beginnings():
    words = toxicity.words_of("Badword badwords " + "other " * 40 + "x" * 3)
    found = toxicity.document_features(words, toxicity._Memo(toxicity.word_features))
    assert {toxicity._number(f) for f in ("wbadword", "4badw", "d4badw", "d6badwor", "wxxx")} <= found
    rare = toxicity.document_features(toxicity.words_of("badword " + "other " * 200), toxicity._Memo(toxicity.word_features))
    assert toxicity._number("4badw") in rare and toxicity._number("d4badw") not in rare


def test_toxicity_sample_is_bounded(spark, monkeypatch):
    """One id in a great many rows is one document of the sample, and no more rows than asked for reach the training."""
    docs, labels, _ = toxic_corpus(400)
    rows = docs + [(docs[0][0], f"again {k} w1 w2") for k in range(10_000)]
    seen = []
    train = toxicity.train_nnpu
    monkeypatch.setattr(toxicity, "train_nnpu", lambda marks, positive, prior: seen.append((len(marks), int(positive.sum()))) or train(marks, positive, prior))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    toxicity.fit_toxicity(frame, spark.createDataFrame(labels, "doc_id long, toxic int"), max_positive=10, max_unlabelled=50, max_judged=20)
    assert seen[0][0] <= 60 and seen[0][1] <= 10


def test_toxicity_query(spark):
    """Held-out documents by the labels, at each size."""
    for size, least in (("sf0.001", 0.9), ("sf0.01", 0.6), ("sf0.1", 0.9)):  # sf0.01 has six, two of them like clean ones
        rows = {r.doc_id: r for r in queries.op8_toxicity(spark, f"/root/testdata/{size}").collect()}
        labels = [(rows[r.doc_id], r.toxic) for r in spark.read.parquet(f"/root/testdata/{size}/labels.parquet").filter("toxic IS NOT NULL").collect() if r.doc_id in rows]
        toxic, clean = [r for r, t in labels if t == 1 and r.held_out], [r for r, t in labels if t == 0 and r.held_out]
        assert sum(r.predicted for r in toxic) >= least * len(toxic)
        assert sum(r.predicted for r in clean) <= 0.01 * len(clean)
        assert all(r.predicted == (r.score >= 0.5) for r in rows.values())


def rule_model(url, rules, default="allow"):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    path = path[: min([path.find(c) for c in "?#" if c in path] or [len(path)])]
    fits = [(len(h + p), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits)[1:] if fits else (None, default)))


def test_url_rules(spark):
    rng = random.Random(7)
    hosts = ["example.org", "a.example.org", "ORG", "xorg", "b.com", "com", "", "a..com", "com.", "example.org:80", "é.com", "a.b.c.d.com"]
    paths = ["", "/", "/es/", "/es", "/en/1", "/en/12?x", "/fr/de/", "/de/?q=/fr/", "/de#f", "?/de/", "/a/b/c/d", "/a/b/x", "/" + "long" * 5000]
    urls = [f"{rng.choice(['http', 'x'])}://{h}{p}" for h in hosts for p in paths] + [None, "", "no scheme", "://", "a://b://c/de/", "http://com/de/\n/x"]
    urls += ["http://com/fr/\U0010ffffx", "http://com/de/\U0010ffff\U0010ffff", "http://com/de/\U0010fffe", "http://com/de/\ud7ff\ue000", "http://com\U0010ffff/de/", "http://com-x.com/de/"]
    urls += ["http://" + "".join(rng.choice("com.\U0010ffff\U0010fffe\ue000-") for _ in range(rng.randint(1, 7))) + "/" + "".join(rng.choice("de/fr\U0010ffff\ud7ff") for _ in range(5)) for _ in range(300)]
    urls += ["http://hot.com/fr/" + str(k) for k in range(700)] + ["http://same.com/de/"] * 500
    rules = [*queries.URL_RULES, ("block", "com", "/a/"), ("allow", "com", "/a/b/"), ("block", "d.com", "/a/b/c/"), ("allow", "example.org", "/es/x"), ("block", "ORG", "/zz"), ("block", "com", "/de/\U0010ffff"), ("allow", "m.com", "/"), ("block", "a/b", "/"), ("allow", "a", "b/")]
    pages = spark.createDataFrame([(k, u, "c", "c") for k, u in enumerate(urls)] + [(None, "http://com/de/", "c", "c")], "page_id long, url string, host string, rule string")
    rows = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_rules.judge_urls(pages, url_rules.rules_frame(spark, rules), blocks=7).collect()}
    lowered = [(v, h.lower(), p) for v, h, p in rules]
    assert len(rows) == len(urls) + 1
    for k, u in enumerate(urls):
        assert rows[k] == rule_model(u, lowered), u
    assert url_rules.judge_urls(pages.limit(0), url_rules.rules_frame(spark, rules)).count() == 0
    none = url_rules.judge_urls(pages, url_rules.rules_frame(spark, rules).limit(0), default="block")
    assert {(r.rule, r.verdict) for r in none.collect()} == {(None, "block")}
    twice = spark.createDataFrame([(1, "http://com/de/")] * 9 + [(None, None)] * 2, "`a.b` long, url string").select(F.col("`a.b`"), "url")
    again = url_rules.judge_urls(twice, url_rules.rules_frame(spark, rules), blocks=3, id_col="a.b")
    assert again.columns == ["a.b", "host", "path", "rule", "verdict"] and sorted(map(repr, again.collect())) == sorted(map(repr, again.collect())) and again.count() == 11
    nodes = url_rules.judge_urls(pages, url_rules.rules_frame(spark, rules))._jdf.queryExecution().toString()
    assert nodes.split("== Physical Plan ==")[1].count("Exchange ") < 10
    assert "Python" not in nodes and "Pandas" not in nodes and "Arrow" not in nodes


def test_url_rows_are_dealt_alike_in_any_order(spark):
    """A task that runs again may meet its rows in another order: each still goes to the block it went to before."""
    rows = [(k, None if k % 3 else b"hot" if k % 2 else str(k).encode()) for k in range(3000)]
    bounds, blocks = [b"2", b"hot", b"hot", b"hot", b"z"], []
    for order in (rows, rows[::-1], sorted(rows, key=lambda r: r[0] * 7919 % 3001)):
        points = spark.createDataFrame(order, "row long, key binary").repartition(3, "key")
        blocks.append({r.row: r.block for r in points.select("row", url_rules.block_of(F.col("key"), F.col("row"), bounds).alias("block")).collect()})
    assert blocks[0] == blocks[1] == blocks[2]
    assert {blocks[0][k] for k, key in rows if key is None} == set(range(6)) and {blocks[0][k] for k, key in rows if key == b"hot"} == {2, 3, 4}


def test_url_query(spark, sf_dir):
    assert_same(queries.op9_url_rules(spark, sf_dir), queries.ORACLES["op9_url_rules"], sf_dir)


def topk_model(rows, k=5, divisor=50, scale=256):
    """Sorted (query_id, rank, vec_id, score) in Python's whole numbers; every row with a query's id asks."""
    own = [(i, [int(np.floor(np.float64(x) * scale)) for x in v]) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for place, (q, v) in enumerate(own):
        if q % divisor == 0:
            found = sorted((-sum(a * b for a, b in zip(v, w)), i) for at, (i, w) in enumerate(own) if at != place and len(w) == len(v))[:k]
            out += [(q, n + 1, i, max(-(2**63), min(2**63 - 1, -s))) for n, (s, i) in enumerate(found)]
    return sorted(out)


@pytest.mark.parametrize("seed", range(3))
def test_top_products(spark, seed):
    rng = np.random.default_rng(seed)
    rows = [(int(k), (rng.normal(size=8) * rng.choice([0.01, 1, 1, 5])).tolist()) for k in range(600)]
    rows = [(i, np.float32(v).tolist()) for i, v in rows]
    rows += [(k, rows[7][1]) for k in range(600, 800)]  # one very common vector
    rows += [(50, rows[3][1]), (50, rows[50][1]), (51, rows[50][1])]  # repeated ids
    rows += [(1000, None), (1050, []), (1100, [1.0, None] * 4), (1150, [float("nan")] * 8), (1200, [float("inf")] * 8), (None, [1.0] * 8), (1250, [0.0] * 8), (1300, [1.0, 2.0]), (1301, [2.0, 2.0])]
    frame = spark.createDataFrame([(k, v, "c", 1.0) for k, v in rows], "vec_id long, embedding array<float>, block string, norm double")
    found = topk.top_products(frame, block_rows=64, seeds=20 if seed else 2048)
    assert sorted(tuple(r) for r in found.collect()) == topk_model(rows)
    assert found.schema.simpleString() == "struct<query_id:bigint,rank:int,vec_id:bigint,score:bigint>"
    assert topk.top_products(frame.limit(0)).count() == 0


def test_top_products_of_large_components(spark):
    rng = np.random.default_rng(8)
    rows = [(k, np.float32(rng.normal(size=4) * s).tolist()) for k, s in enumerate(rng.choice([1, 1e6, 1e9, 1e20, 3e37], 200))]
    rows += [(300, [3e38] * 4), (301, [-3e38] * 4), (350, [float(np.float32(3e38))] * 4)]
    rows = [(i, np.float32(v).tolist()) for i, v in rows]
    found = topk.top_products(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), block_rows=16, seeds=10)
    assert sorted(tuple(r) for r in found.collect()) == topk_model(rows)
    with pytest.raises(Exception, match="vec_id 7"):
        topk.top_products(spark.createDataFrame([(7, [1e300, 1.0]), (8, [1.0, 1.0])], "vec_id long, embedding array<double>")).collect()


def test_prune_keeps_what_can_reach_the_limit():
    rng = np.random.default_rng(5)
    for _ in range(300):
        vectors = rng.integers(-50, 50, (60, 4))
        vectors = vectors[np.argsort(-np.sqrt((vectors**2).sum(1)), kind="stable")]
        norms = np.sqrt((vectors.astype(float) ** 2).sum(1))
        q = rng.integers(-50, 50, 4)
        scores = vectors @ q
        limit = float(np.sort(scores)[-rng.integers(1, 20)])
        kept = topk.prune(q, float(np.sqrt((q**2).sum())), limit, vectors, norms)
        assert set(np.flatnonzero(scores >= limit)) <= set(kept.tolist())


def test_top_query(spark, sf_dir):
    assert_same(queries.op10_top_products(spark, sf_dir), queries.ORACLES["op10_top_products"], sf_dir)
