"""Filter audit, whitening and forest search, against brute force."""

import itertools
from collections import Counter, defaultdict

import numpy as np
import pytest
from helpers import assert_same

from scriptorium.llm import filter_audit, forest, queries, whitening


def failures(text):
    """A to D, counted character by character."""
    words, at = [], ""
    for c in text + " ":
        if c in " \t\n\x0b\x0c\r":
            words += [at] if at else []
            at = ""
        else:
            at += c
    capitals = sum("A" <= c <= "Z" for c in text)
    return "".join(
        f for f, bad in (
            ("A", len(words) < 50), ("B", 100 * len(set(words)) < 65 * len(words)), ("C", 100 * capitals > 5 * len(text)), ("D", any(c in "#$%&*|" for c in text)),
        ) if bad
    )


def audit(documents, labels):
    """Every order applied to every document in turn."""
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    parts = defaultdict(list)
    for i, text, source in documents:
        fails = failures(text or "")
        if i is not None and any(j is not None and j < i and (t or "") == (text or "") for j, t, _ in documents):
            fails += "E"
        parts[source or ""].append((i, fails))
    out = {}
    for part, rows in parts.items():
        for order in itertools.permutations("ABCDE"):
            left = list(rows)
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                out[part, "".join(order), step] = [
                    len(left), len(gone), sum(f in r[1] for r in rows) - len(gone), sum(r[1] == f for r in rows), sum(r[0] in good for r in gone), sum(r[0] in toxic for r in gone),
                ]
    total = Counter()
    for (part, order, step), v in out.items():
        total[part, order[step - 1]] += v[1]
    return {k: (*v, total[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def audited(spark, documents, labels):
    docs = spark.createDataFrame([(*d, "x", 1) for d in documents], "doc_id long, text string, source string, mask string, key int")
    rows = filter_audit.audit_filters(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    return {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in rows}


def test_audit_matches_every_order(spark):
    long = " ".join(f"word{i}" for i in range(80))
    same = "copy " * 90
    documents = [
        (1, long, "a"), (2, long, "b"), (2, long, "b"), (3, same, "a"), (4, same, None), (5, None, "a"), (6, "", ""), (7, "#", "a"), (7, long + " $", "b"), (None, long, "a"),
        (None, "LOUD " * 60, "a"), (8, "LOUD and\x0bnot " * 60, "c"), (9, "ÄÖÜ é 漢字", "c"), (10, long * 4000, "c"), (11, long * 4000, "a"),
    ]
    labels = [(1, 1, 0), (1, 0, 1), (2, 1, 1), (4, None, 1), (7, 1, 0), (None, 1, 1), (11, 1, None), (99, 1, 1)]
    assert audited(spark, documents, labels) == audit(documents, labels)


def test_audit_of_many_copies(spark):
    documents = [(i, "one hot text", "a" if i % 3 else "b") for i in range(1500)] + [(9000 + i, f"# other {i}", "b") for i in range(200)] + [(None, f"no id {i}", "n") for i in range(300)]
    labels = [(i, i % 2, i % 3 == 0) for i in range(0, 1500, 7)]
    labels = [(i, q, int(t)) for i, q, t in labels]
    assert audited(spark, documents, labels) == audit(documents, labels)


def test_audit_of_nothing(spark):
    assert audited(spark, [], []) == {}
    assert len(audited(spark, [(1, "a", None)], [])) == 600


def test_polynomial_corners_and_shapley():
    rng = np.random.default_rng(3)
    counts = [int(x) for x in rng.integers(0, 50, 32)]
    polynomial = filter_audit.removal_polynomial(counts)
    corners = filter_audit.corner_values(polynomial)
    for on in range(32):
        assert corners[on] == sum(n for m, n in enumerate(counts) if m & on)
    assert sum(filter_audit.shapley_values(polynomial)) == sum(counts[1:])


def test_op11_query(spark, sf_dir):
    assert_same(queries.op11_filter_shapley(spark, sf_dir), queries.OP11_SQL, sf_dir)


# Whitening


def plain_whitening(vectors):
    """Rows (id, n, deviation, components) by numpy's eigh."""
    kept = [(i, [int(np.floor(256 * float(c))) for c in v]) for i, v in vectors if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in kept})
    n, total = len(fit), [sum(c) for c in zip(*fit)]
    m = np.array(fit, float) - np.array(total) / n
    values, axes = np.linalg.eigh(m.T @ m / n)
    values, axes = values[::-1], axes[:, ::-1]
    z = (np.array([x for _, x in kept]) - np.array(total) / n) @ axes / np.sqrt(np.maximum(values, 1e-300))
    deviations = [sum((n * c - t) ** 2 for c, t in zip(x, total)) for _, x in kept]
    return kept, n, deviations, z, values / values.sum()


def compare(rows, vectors, components=4):
    kept, n, deviations, z, shares = plain_whitening(vectors)
    got = defaultdict(list)
    for r in rows:
        got[r.component].append(r)
    assert sorted(got) == list(range(1, components + 1))
    for k, own in got.items():
        assert len(own) == len(kept)
        want = {(i, tuple(x)): (d, z[j, k - 1]) for j, ((i, x), d) in enumerate(zip(kept, deviations))}
        by_id = defaultdict(list)
        for (i, _), v in want.items():
            by_id[i].append(v)
        sign = None
        for r in own:
            assert r.n == n and abs(r.explained / shares[k - 1] - 1) < 1e-6 and r.identity_error < 1e-8
            fits = [v for v in by_id[r.vec_id] if v[0] == r.deviation]
            assert fits
            if sign is None and abs(fits[0][1]) > 1e-3:
                sign = np.sign(fits[0][1] * r.whitened)
            assert any(abs(v[1] * (sign or 1) - r.whitened) < 1e-6 for v in fits)


def test_whitening_query(spark, sf_dir):
    vectors = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    compare(queries.op12_jacobi_whitening(spark, sf_dir).collect(), vectors)


def test_whitening_of_odd_rows(spark):
    rng = np.random.default_rng(5)
    base = (rng.normal(size=(60, 6)) * [3, 2, 1, 0.5, 0.1, 0.02]).tolist()
    vectors = [(i, v) for i, v in enumerate(base)] + [(100 + i, base[0]) for i in range(40)] + [(7, base[7]), (None, base[9])]
    vectors += [(200, None), (201, [None] + base[0][1:]), (202, [float("nan")] + base[0][1:]), (203, [float("inf")] + base[0][1:]), (204, [-0.0] * 6), (205, [0.0] * 6)]
    df = spark.createDataFrame([(i, v, "x") for i, v in vectors], "vec_id long, embedding array<double>, n string")
    compare(whitening.whiten(df).collect(), vectors)


def test_whitening_of_few_directions(spark):
    shape = "vec_id long, embedding array<double>"
    assert whitening.whiten(spark.createDataFrame([], shape)).collect() == []
    assert whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], shape)).collect() == []
    assert whitening.whiten(spark.createDataFrame([(1, [])], shape)).collect() == []
    line = spark.createDataFrame([(i, [i / 256, i / 128, 0.0]) for i in range(9)], shape)
    rows = whitening.whiten(line).collect()
    assert len(rows) == 9 and {r.component for r in rows} == {1} and abs(rows[0].explained - 1) < 1e-12
    mixed = spark.createDataFrame([(1, [0.0, 1.0]), (2, [1.0, 0.5]), (3, [1.0]), (4, [2.0]), (5, [9.0])], shape)
    assert Counter(r.vec_id for r in whitening.whiten(mixed).collect()) == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1}
    huge = spark.createDataFrame([(i, [float(i) * 1e12, float(i * i)]) for i in range(5)], shape)
    assert {r.deviation for r in whitening.whiten(huge).collect()} == {None, 6553600}  # the middle row lies at the mean but for (5 * 1024 - 7680) squared


def test_jacobi_keeps_small_eigenvalues():
    rng = np.random.default_rng(1)
    for n in (1, 2, 17):
        m = rng.normal(size=(n, n))
        values, vectors = whitening.jacobi(m @ m.T)
        assert np.allclose(values, np.linalg.eigvalsh(m @ m.T)[::-1], rtol=1e-9)
        assert np.allclose(vectors.T @ vectors, np.eye(n), atol=1e-12) and np.allclose(vectors * values @ vectors.T, m @ m.T, atol=1e-10)
    # graded: the least eigenvalue to full relative accuracy, which a method that works to the norm misses
    scale = np.diag(10.0 ** -np.arange(0, 16, 3))
    core = np.eye(6) + 0.1
    values, _ = whitening.jacobi(scale @ core @ scale)
    assert abs(values.prod() / (np.linalg.det(core) * np.prod(np.diag(scale)) ** 2) - 1) < 1e-12


# Neighbours


def plain_neighbours(vectors, k, divisor):
    kept = [(i, np.array(v, float)) for i, v in vectors if i is not None and v is not None and len(v) and all(c is not None and np.isfinite(c) for c in v) and any(v)]
    out = []
    for at, (i, v) in enumerate(kept):
        if i % divisor:
            continue
        scores = [(-float((v * w).sum() / (np.sqrt((v * v).sum()) * np.sqrt((w * w).sum()))), j) for b, (j, w) in enumerate(kept) if b != at and len(w) == len(v)]
        out.append((i, sorted(scores)[:k]))
    return out


def found_by_query(rows):
    got = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r.query_id, r.rank)):
        got[r.query_id].append(r)
    return got


def recall(rows, vectors, k=5, divisor=50):
    got, hits, n = found_by_query(rows), 0, 0
    for i, want in plain_neighbours(vectors, k, divisor):
        own = got[i]
        assert [r.rank for r in own] == list(range(1, len(want) + 1))
        assert all((-a.score, a.vec_id) < (-b.score, b.vec_id) for a, b in itertools.pairwise(own))
        hits += sum(r.score >= -want[-1][0] - 1e-12 for r in own)
        n += len(want)
    return hits / n


@pytest.mark.parametrize("leaf_rows", [16, 512])
def test_forest_recall_on_the_table(spark, sf_dir, leaf_rows):
    embeddings = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    vectors = [(r.vec_id, r.embedding) for r in embeddings.collect()]
    assert recall(forest.neighbours(embeddings, leaf_rows=leaf_rows).collect(), vectors) >= 0.9


def test_op13_query_is_exact_on_one_leaf(spark, sf_dir):
    vectors = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    got = found_by_query(queries.op13_projection_forest(spark, sf_dir).collect())
    for i, want in plain_neighbours(vectors, 5, 50):
        assert [r.vec_id for r in got[i]] == [j for _, j in want]
        assert np.allclose([r.score for r in got[i]], [-s for s, _ in want], rtol=0, atol=1e-14)


def clustered(seed, n, dim=16, centres=30):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(centres, dim))
    return [(i, (middle[i % centres] + 0.2 * rng.normal(size=dim)).tolist()) for i in range(n)]


def test_forest_opens_few_leaves_of_clusters(spark):
    vectors = clustered(2, 3000)
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    assert recall(forest.neighbours(df, leaf_rows=64).collect(), vectors) >= 0.9
    x = forest.units(np.array([v for _, v in vectors]))
    made = forest.fit_forest(x, 6, 4)
    leaves = made.route(x)
    opened = list(made.visits(x[:200], 24))
    truth = np.argsort(-(x[:200] @ x.T), 1)[:, 1:6]
    assert np.mean([len(set(leaves[t]) & set(o)) > 0 for row, o in zip(truth, opened) for t in row]) > 0.9
    assert all(leaves[i, t] in o for i, o in enumerate(opened) for t in range(4))  # its own leaf in each tree comes first


def test_forest_edges(spark):
    shape = "vec_id long, embedding array<double>, key string, row int"
    table = lambda rows: spark.createDataFrame([(*r, "x", 1) for r in rows], shape)
    assert forest.neighbours(table([])).collect() == []
    assert forest.neighbours(table([(0, [1.0, 2.0])])).collect() == []
    odd = [(0, [0.0, 0.0]), (50, None), (100, [None, 1.0]), (150, [float("nan"), 1.0]), (200, [float("inf"), 1.0]), (250, []), (None, [1.0, 1.0]), (300, [1.0, 0.0]), (301, [-0.0, 1.0]), (302, [0.0, 1.0])]
    rows = forest.neighbours(table(odd)).collect()
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in rows] == [(300, 1, 301, 0.0), (300, 2, 302, 0.0)]
    # equal rows, shared ids, one hot vector, extreme lengths, two dimensions
    rng = np.random.default_rng(8)
    vectors = [(i, [1.0, 2.0, 3.0]) for i in range(400)] + [(50, [1.0, 2.0, 3.0]), (50, [3.0, 2.0, 1.0]), (1000, [1e-200, 0.0, 1e-200]), (1050, [1e200, 0.0, 1e200])]
    vectors += [(2000 + i, rng.normal(size=3).tolist()) for i in range(300)] + [(4000, [1.0, 1.0]), (4001, [2.0, 2.5])]
    for leaf_rows in (16, 4096):
        got = forest.neighbours(table(vectors), leaf_rows=leaf_rows).collect()
        for r in got:
            assert r.query_id % 50 == 0
        by = found_by_query(got)
        assert [r.vec_id for r in by[0]] == [1, 2, 3, 4, 5]
        assert sorted((r.rank, r.vec_id) for r in by[50])[:2] == [(1, 0), (1, 0)] and len(by[50]) == 15
        assert by[1000][0].vec_id == 1050 and abs(by[1000][0].score - 1) < 1e-15
        assert [(r.vec_id, r.rank) for r in by[4000]] == [(4001, 1)]
