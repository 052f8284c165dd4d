"""Approximate nearest neighbours by a forest of random-projection trees.

A tree halves the sphere again and again: a node projects on the difference of two sampled directions and parts at the median of
its sampled projections. Every row is filed in one leaf of each tree. A query walks all trees at once: one priority queue
holds the branches not taken, the nearest first (the sum of the squared distances to the planes that were crossed), until
so many leaves are open as the budget says. The rows of these leaves are its candidates, and their cosines are computed whole.

How many leaves to open depends on the data (a few where vectors lie in clusters, most of them where they lie at random), so
the budget is fitted: a bounded sample of queries is searched exactly, and the budget is the least that finds the wanted
share of their neighbours. It holds for all queries.

The forest is fitted on a bounded sample, and has at most MOST_LEAVES leaves a tree; all rows are indexed. Beyond that size leaves
grow with the table, and are dealt over tasks in blocks.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.llm.common import cut, hot_keys, spread_join

#: Leaves of a tree at most, sampled rows for each, and bytes of the sample: what the driver holds and what is broadcast is bounded by these.
MOST_LEAVES, ROWS_A_LEAF, SAMPLE_BYTES = 1024, 16, 1 << 25
#: Scores this near to the last one kept are computed anew, value by value, before they are ordered.
NEAR = 1e-9
INDEXED = "row long, vec_id long, own binary, key binary"


def scaled(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors times a power of two each, which changes no digit, and their lengths, so that squares neither overflow nor vanish."""
    most = np.abs(vectors).max(1)
    y = np.ldexp(vectors, -np.frexp(most)[1][:, None])
    return y, np.sqrt((y * y).sum(1))


def units(vectors: np.ndarray) -> np.ndarray:
    y, length = scaled(vectors)
    return y / length[:, None]


@dataclass(frozen=True)
class Forest:
    """`planes` (trees, nodes, dim) of unit normals and `offsets` (trees, nodes); node n has the children 2n + 1 (below) and 2n + 2. Leaf numbers run over all trees."""

    planes: np.ndarray
    offsets: np.ndarray
    depth: int

    @property
    def leaves(self) -> int:
        return 1 << self.depth

    @property
    def trees(self) -> int:
        return len(self.planes)

    def route(self, unit: np.ndarray) -> np.ndarray:
        """(rows, trees): the leaf of each vector in each tree."""
        out = np.zeros((len(unit), self.trees), np.int32)
        for t in range(self.trees):
            node = np.zeros(len(unit), np.int64)
            for _ in range(self.depth):
                above = (unit * self.planes[t, node]).sum(1) > self.offsets[t, node]
                node = 2 * node + 1 + above
            out[:, t] = t * self.leaves + node - (self.leaves - 1)
        return out

    def visits(self, unit: np.ndarray, budget: int) -> Iterator[list[int]]:
        """The first `budget` leaves that each vector opens, in order: one priority queue for all trees."""
        inner = self.leaves - 1
        for v in unit:
            margins = self.planes @ v - self.offsets
            queue = [(0.0, t, 0) for t in range(self.trees)]
            found: list[int] = []
            while queue and len(found) < budget:
                crossed, t, node = heapq.heappop(queue)
                while node < inner:
                    margin = float(margins[t, node])
                    above = margin > 0
                    heapq.heappush(queue, (crossed + margin * margin, t, 2 * node + 2 - above))
                    node = 2 * node + 1 + above
                found.append(t * self.leaves + node - inner)
            yield found


def fit_forest(sample: np.ndarray, depth: int, trees: int, seed: int = 11) -> Forest:
    """A forest of `trees` trees on sampled unit vectors. A node that holds less than two of them, or only equal ones, parts at random."""
    rng = np.random.default_rng(seed)
    nodes, dim = (1 << depth) - 1, sample.shape[1]
    planes, offsets = np.zeros((trees, nodes, dim)), np.zeros((trees, nodes))
    for t in range(trees):
        held = {0: np.arange(len(sample))}
        for node in range(nodes):
            own = held.pop(node)
            a, b = rng.choice(own, 2, replace=False) if len(own) > 1 else (0, 0)
            normal = sample[a] - sample[b]
            if not normal.any():
                normal = rng.normal(size=dim)
            normal = normal / np.sqrt((normal * normal).sum())
            at = (sample[own] * normal).sum(1)
            planes[t, node], offsets[t, node] = normal, np.median(at) if len(own) else 0.0
            if 2 * node + 2 < nodes:
                held[2 * node + 1], held[2 * node + 2] = own[at <= offsets[t, node]], own[at > offsets[t, node]]
    return Forest(planes, offsets, depth)


def sound_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, np.dtype]:
    """(row, vec_id, own, key, dim), and how components are stored: the components as bytes, without loss, and 128 bits that stand for the vector. Rows without an id, and vectors that are
    null, empty, zero, or hold a null or non-finite component, are left out."""
    x = F.col(f"`{vector_col}`")
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")))
    found = vectors.filter(finite & F.exists(x, lambda c: c != 0)).select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), x.alias("x"))
    kind = np.dtype("<f4" if found.schema["x"].dataType.elementType.typeName() == "float" else "<f8")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = np.asarray(batch["x"].value_lengths())
            values = np.asarray(batch["x"].flatten(), kind) + kind.type(0)  # -0.0 and 0.0 are one value
            rows = np.split(values, np.cumsum(lengths)[:-1]) if len(lengths) else []
            own = [x.tobytes() for x in rows]
            keys = [hashlib.blake2b(x, digest_size=16).digest() for x in own]
            yield pa.RecordBatch.from_arrays(
                [batch["vec_id"], pa.array(own, pa.binary()), pa.array(keys, pa.binary()), pa.array(lengths, pa.int32())], ["vec_id", "own", "key", "dim"]
            )

    made = found.filter("vec_id IS NOT NULL").mapInArrow(run, "vec_id long, own binary, key binary, dim int")
    return made.withColumn("row", F.monotonically_increasing_id()), kind


def unpacked(column, kind: np.dtype) -> np.ndarray:
    """(rows, dim) doubles of a column of vectors as bytes."""
    held = list(column)
    return np.frombuffer(b"".join(held), kind).reshape(len(held), -1).astype(float)


def nearest(queries: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each query the places of its k rows of largest cosine, and these cosines; the smaller id first where they are equal."""
    (q, q_length), (r, r_length) = scaled(queries), scaled(rows)
    about = (q @ r.T) / (q_length[:, None] * r_length[None, :])
    out = []
    for i, line in enumerate(about):
        least = np.partition(line, len(line) - k)[len(line) - k] if len(line) > k else -np.inf
        at = np.flatnonzero(line >= least - NEAR)
        score = (r[at] * q[i]).sum(1) / (r_length[at] * q_length[i])
        order = np.lexsort((ids[at], -score))[:k]
        out.append((at[order], score[order]))
    return out


def exact_neighbours(heads: DataFrame, asked: list[tuple[bytes, bytes]], kind: np.dtype, k: int) -> dict[bytes, list[tuple[int, bytes]]]:
    """{key: (row, vector) of the k nearest rows} of a bounded number of query vectors, each compared with every row."""
    shared = heads.sparkSession.sparkContext.broadcast(asked)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        queries = unpacked([v for _, v in shared.value], kind)
        for rows in frames:
            ids, numbers = rows["vec_id"].to_numpy(), rows["row"].to_numpy()
            found = nearest(queries, unpacked(rows["own"], kind), ids, k)
            yield pd.DataFrame([(shared.value[i][0], float(s), int(ids[n]), int(numbers[n]), rows["own"].iloc[n]) for i, (at, score) in enumerate(found) for n, s in zip(at, score, strict=True)], columns=["asked", "score", "vec_id", "row", "own"])

    found = heads.select("row", "vec_id", "own").mapInPandas(run, "asked binary, score double, vec_id long, row long, own binary")
    place = F.row_number().over(Window.partitionBy("asked").orderBy(F.desc("score"), "vec_id", "row"))
    out: dict[bytes, list[tuple[int, bytes]]] = {}
    for r in found.withColumn("__k", place).filter(F.col("__k") <= k).select("asked", "row", "own", "__k").orderBy("__k").collect():
        out.setdefault(bytes(r.asked), []).append((r.row, bytes(r.own)))
    return out


def fit_budget(forest: Forest, kind: np.dtype, asked: list, truth: dict, k: int, recall: float) -> int:
    """The least number of leaves that holds the wanted share of the sampled queries' neighbours."""
    ranks: list[int] = []
    for r in asked:
        others = [v for row, v in truth.get(bytes(r.key), []) if row != r.row][:k]
        if not others:
            continue
        order = next(forest.visits(units(unpacked([bytes(r.own)], kind)), forest.trees * forest.leaves))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        ranks += place[forest.route(units(unpacked(others, kind)))].min(1).tolist()
    if not ranks:
        return forest.trees * forest.leaves
    return int(np.sort(ranks)[int(np.ceil(recall * len(ranks))) - 1]) + 1


def neighbours(
    vectors: DataFrame, k: int = 5, divisor: int = 50, trees: int = 4, leaf_rows: int = 512, recall: float = 0.97, sampled_queries: int = 128,
    block_rows: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding",
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows found for each query, by cosine in double precision, ties to the smaller vec_id.

    Queries are the rows whose vec_id is divisible by `divisor`; candidates are all rows but the query's own. Rows that share an id are
    rows: each asks, and each counts. Of rows with equal vectors the first k + 1 by id are candidates, which loses nothing. Vectors of different
    dimensions aren't compared; each dimension is searched by itself. See `sound_vectors` for rows that take no part. Other columns are
    ignored; an empty table gives no rows. A table of up to `leaf_rows` different vectors is one leaf, so its search is exact.
    """
    found, kind = sound_vectors(vectors, id_col, vector_col)
    rows = cut(found)
    dims = sorted(r.dim for r in rows.select("dim").distinct().collect())
    parts = [_search(rows.filter(F.col("dim") == d).drop("dim"), d, kind, k, divisor, trees, leaf_rows, recall, sampled_queries, block_rows) for d in dims]
    out = vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    for part in parts:
        out = out.unionByName(part)
    return out


def _search(rows, dim, kind, k, divisor, trees, leaf_rows, recall, sampled_queries, block_rows) -> DataFrame:
    spark = rows.sparkSession
    place = F.row_number().over(Window.partitionBy("key").orderBy("vec_id", "row"))
    heads = rows.withColumn("place", place).filter(F.col("place") <= k + 1)  # a task sends k + 1 rows of a vector at most
    drawn = F.xxhash64("key")
    most = max(2, min(MOST_LEAVES * ROWS_A_LEAF, SAMPLE_BYTES // (8 * dim)))
    heads = cut(heads)
    different = heads.filter("place = 1")
    depth, n = 0, different.count()
    while depth < (MOST_LEAVES - 1).bit_length() and n > leaf_rows << depth and most > ROWS_A_LEAF << depth:
        depth += 1
    sample = units(unpacked([bytes(r.own) for r in different.orderBy(drawn, "key").limit(most).select("own").collect()], kind))
    forest = fit_forest(sample, depth, trees if depth else 1)

    queries = rows.filter(F.col("vec_id") % divisor == 0).select("row", "vec_id", "key", "own")
    asked = queries.orderBy(F.xxhash64("row"), "row").limit(sampled_queries).collect()
    pairs = list({bytes(r.key): bytes(r.own) for r in asked}.items())
    budget = fit_budget(forest, kind, asked, exact_neighbours(heads, pairs, kind, k + 1) if pairs and depth else {}, k, recall)
    shared = spark.sparkContext.broadcast(forest)  # trees * MOST_LEAVES planes at most

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                leaves = shared.value.route(units(unpacked(batch["own"].to_pylist(), kind)))
                yield pa.RecordBatch.from_arrays(
                    [*(batch[c] for c in ("row", "vec_id", "own", "key")), pa.array(leaves.tolist(), pa.list_(pa.int32()))], ["row", "vec_id", "own", "key", "leaves"]
                )

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                leaves = list(shared.value.visits(units(unpacked(batch["own"].to_pylist(), kind)), budget))
                yield pa.RecordBatch.from_arrays([batch["own"], batch["key"], pa.array(leaves, pa.list_(pa.int32()))], ["own", "key", "leaves"])

    filed = cut(heads.select("row", "vec_id", "own", "key").mapInArrow(file, INDEXED + ", leaves array<int>"))
    wanted = cut(queries.dropDuplicates(["key"]).select("own", "key").mapInArrow(ask, "own binary, key binary, leaves array<int>"))
    # leaves are cut into blocks of rows and of queries, and each pair of blocks of a leaf is a group of bounded size
    blocks = [d.select(F.explode("leaves").alias("leaf")).groupBy("leaf").agg(F.ceil(F.count("*") / block_rows).cast("int").alias(n)) for d, n in ((filed, "row_blocks"), (wanted, "query_blocks"))]
    blocks = spark.createDataFrame(blocks[0].join(blocks[1], "leaf").collect(), "leaf int, row_blocks int, query_blocks int")  # a row a leaf
    blocks = F.broadcast(blocks)
    dealt = lambda column, n: F.pmod(F.xxhash64(column), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = filed.select("row", "vec_id", "own", F.explode("leaves").alias("leaf")).join(blocks, "leaf")
    left = left.select("leaf", dealt("row", "row_blocks").alias("a"), each("query_blocks").alias("b"), "row", "vec_id", "own")
    right = wanted.select("key", "own", F.explode("leaves").alias("leaf")).join(blocks, "leaf")
    right = right.select("leaf", each("row_blocks").alias("a"), dealt("key", "query_blocks").alias("b"), "key", "own")

    def rerank(held: pd.DataFrame, asking: pd.DataFrame) -> pd.DataFrame:
        names = ["key", "score", "vec_id", "row"]
        if not len(held) or not len(asking):
            return pd.DataFrame({c: [] for c in names})
        ids, numbers = held["vec_id"].to_numpy(), held["row"].to_numpy()
        found = nearest(unpacked(asking["own"], kind), unpacked(held["own"], kind), ids, k + 1)
        return pd.DataFrame({
            "key": np.repeat(asking["key"].to_numpy(object), [len(at) for at, _ in found]), "score": np.concatenate([s for _, s in found]),
            "vec_id": np.concatenate([ids[at] for at, _ in found]), "row": np.concatenate([numbers[at] for at, _ in found]),
        })

    group = ["leaf", "a", "b"]
    best = left.groupBy(*group).cogroup(right.groupBy(*group)).applyInPandas(rerank, "key binary, score double, vec_id long, row long")
    # a query has k + 1 rows of each leaf it opened at most
    entry = F.struct((-F.col("score")).alias("down"), "vec_id", "row")
    best = best.groupBy("key").agg(F.slice(F.array_sort(F.collect_set(entry)), 1, k + 1).alias("best"))
    own = queries.select("key", F.col("row").alias("own_row"), F.col("vec_id").alias("query_id"))
    answered = spread_join(own, best, ["key"], hot_keys(own.groupBy("key").agg(F.count("*").alias("n")), ["key"]))
    others = F.slice(F.filter("best", lambda x: x["row"] != F.col("own_row")), 1, k)
    return answered.select("query_id", F.posexplode(others).alias("at", "x")).select(
        "query_id", (F.col("at") + 1).alias("rank"), F.col("x.vec_id").alias("vec_id"), (-F.col("x.down")).alias("score")
    )
