"""Exact top-k inner products by norm-bucketed retrieval.

Vectors are grouped by length into buckets whose lengths differ by a fixed ratio, and large buckets are dealt over
blocks. Products with a bounded set of the longest vectors give each query a lower limit on its k-th best score.
Against a block, this limit over the query's length and the block's greatest length is the local
cosine threshold. Above 1 the block can't hold a result. Where it is high, coordinate pruning keeps
the vectors whose component along the query's largest coordinate lies in the range that the threshold
allows; otherwise length pruning keeps the vectors that are long enough. The products of what remains are
computed whole, and a limit is never above the true k-th best, so the result is exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.llm.common import cut

#: Lengths within a bucket differ by this ratio at most.
RATIO = 1.15
#: From this local cosine threshold on, coordinates prune better than lengths.
BY_COORDINATE = 0.6
PACKED = "dim int, bucket long, block int, n int, longest double, rows binary, ids binary, vectors binary"
#: Scores are of 64 bits; beyond, they are the nearest such number, and the exact ones decide the order.
LEAST_SCORE, MOST_SCORE = -(2**63), 2**63 - 1


def quantise(vectors: DataFrame, scale: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, v array<double>, dim, norm): floor(scale * x) of each component, whole numbers as doubles, exact at any size. Rows without
    an id, with an empty or null vector, or with a null or non-finite component are left out. A vector whose length
    isn't finite in double (components over some 1e150) is an error that names its id."""
    x = F.col(f"`{vector_col}`")
    sound = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")))
    scaled = lambda c: c.cast("double") * scale
    whole = F.transform("x", lambda c: F.when(F.abs(scaled(c)) < 2.0**53, F.floor(scaled(c)).cast("double")).otherwise(scaled(c)))
    found = vectors.filter(sound & (F.size(x) > 0)).select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), x.alias("x"))
    found = found.filter("vec_id IS NOT NULL").select("vec_id", whole.alias("v"))
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, c: a + c * c))
    named = F.raise_error(F.concat(F.lit("vec_id "), F.col("vec_id"), F.lit(": a vector too long for inner products"))).cast("double")
    return found.select("vec_id", "v", F.size("v").alias("dim"), F.when(length < float("inf"), length).otherwise(named).alias("norm"))


def products(rows: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Exact inner products (rows by queries) of whole numbers: in floating point, in 64 bits, or else in Python's whole numbers."""
    if not len(rows) or not len(queries):
        return np.zeros((len(rows), len(queries)), np.int64)
    most = float(np.abs(rows).max()) * float(np.abs(queries).max()) * rows.shape[1]
    if most < 2.0**53:
        return (rows @ queries.T).astype(np.int64)
    if most < 2.0**62:
        return rows.astype(np.int64) @ queries.astype(np.int64).T
    exact = lambda vectors: np.array([[int(c) for c in v] for v in vectors], object)
    return exact(rows) @ exact(queries).T


def prune(query: np.ndarray, length: float, limit: float, vectors: np.ndarray, norms: np.ndarray) -> np.ndarray:
    """Which vectors of a block, sorted by length from the longest, may reach `limit` with the query."""
    slack = 1e-9
    if limit == -np.inf or length == 0:
        return np.arange(len(norms)) if limit <= 0 else np.arange(0)
    if limit <= 0:
        return np.arange(len(norms))
    cosine = limit / (length * max(norms[0], 1e-300))
    if cosine > 1 + slack:
        return np.arange(0)
    long = int(np.searchsorted(-norms, -(limit / length) * (1 - slack), "right"))
    if cosine < BY_COORDINATE:
        return np.arange(long)
    # For unit vectors at an angle of at most acos(cosine) from the query, a coordinate lies within this range of the query's.
    focus = int(np.argmax(np.abs(query)))
    cosine = min(cosine, 1.0)
    at, spread = np.arccos(np.clip(query[focus] / length, -1, 1)), np.arccos(cosine)
    own = vectors[:long, focus] / np.maximum(norms[:long], 1e-300)
    low, high = np.cos(min(np.pi, at + spread)), np.cos(max(0.0, at - spread))
    return np.flatnonzero((own >= low - 1e-7) & (own <= high + 1e-7))


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, the smaller id first among equal ones."""
    if scores.dtype == object:
        return np.array(sorted(range(len(scores)), key=lambda n: (-scores[n], ids[n]))[:k], np.int64)
    if len(scores) > 4 * k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        some = np.flatnonzero(scores >= least)
        return some[np.lexsort((ids[some], -scores[some]))[:k]]
    return np.lexsort((ids, -scores))[:k]


def _pack(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values(["norm", "vec_id"], ascending=[False, True])
    return pd.DataFrame(
        {
            "dim": [int(key[0])],
            "bucket": [int(key[1])],
            "block": [int(key[2])],
            "n": [len(rows)],
            "longest": [float(rows["norm"].iloc[0])],
            "rows": [rows["row"].to_numpy("<i8").tobytes()],
            "ids": [rows["vec_id"].to_numpy("<i8").tobytes()],
            "vectors": [np.stack(rows["v"].to_numpy()).astype("<f8").tobytes()],
        }
    )


def top_products(vectors: DataFrame, k: int = 5, divisor: int = 50, scale: int = 256, block_rows: int = 1024, seeds: int = 2048) -> DataFrame:
    """(query_id, rank, vec_id, score) of each query's k highest inner products with other rows (all, if there are fewer).

    Queries are the rows whose vec_id is divisible by `divisor`; candidates are all rows but the query's own. Ties go to the
    smaller vec_id. Vectors of different dimensions aren't compared. Rows that share an id are rows: each asks, and each counts. A
    score beyond 64 bits is given as the nearest number that has them, in the exact scores' order. See `quantise` for rows that take
    no part. An empty table gives no rows, and other columns are ignored.
    A task holds one block of queries and one of candidates at a time.
    """
    rows = cut(quantise(vectors, scale).withColumn("row", F.monotonically_increasing_id()))
    bucket = F.when(F.col("norm") > 0, F.floor(F.log("norm") / float(np.log(RATIO)))).otherwise(F.lit(-1)).cast("long")
    rows = rows.withColumn("bucket", bucket)
    sizes = rows.groupBy("dim", "bucket").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("n_blocks"))
    dealt = rows.join(F.broadcast(sizes), ["dim", "bucket"]).select(  # a row per dimension and bucket of lengths
        "dim", "bucket", F.pmod(F.xxhash64("row"), F.col("n_blocks")).cast("int").alias("block"), "row", "vec_id", "v", "norm"
    )
    blocks = cut(dealt.groupBy("dim", "bucket", "block").applyInPandas(_pack, PACKED))

    longest = rows.orderBy(F.desc("norm"), "row").limit(seeds).select("row", "v", "dim").collect()
    first = {d: [r for r in longest if r.dim == d] for d in {r.dim for r in longest}}
    first = {d: (np.array([r.row for r in own]), np.array([r.v for r in own])) for d, own in first.items()}

    def limits(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for own in frames:
            found = np.full(len(own), -np.inf)
            for dim, at in own.groupby("dim").indices.items():
                if dim not in first:
                    continue
                held, seen = first[dim]
                scores = products(seen, np.stack(own["v"].to_numpy()[at])).astype(float)
                scores[held[:, None] == own["row"].to_numpy()[at][None, :]] = -np.inf
                if len(held) >= k:
                    found[at] = np.partition(scores, len(held) - k, 0)[len(held) - k]
            large = np.isfinite(found) & (np.abs(found) >= 2.0**53)  # rounded, so a little lower
            yield own.assign(limit=np.where(large, found - np.abs(found) * 2.0**-50, found))

    asked = rows.filter(F.col("vec_id") % divisor == 0).select("row", "vec_id", "v", "dim", "norm")
    asked = cut(asked.mapInPandas(limits, "row long, vec_id long, v array<double>, dim int, norm double, limit double"))
    # queries that need vectors of like length go together, so that whole blocks drop out for all of them
    need = F.when((F.col("limit") <= 0) | (F.col("norm") == 0), F.lit(0.0)).otherwise(F.col("limit") / F.col("norm"))
    band = F.when(need > 0, F.floor(F.log(need) / float(np.log(RATIO)))).otherwise(F.lit(-1))
    asked = asked.withColumn("need", need).withColumn("band", band)
    bands = asked.groupBy("dim", "band").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("n_blocks"))
    asked = asked.join(F.broadcast(bands), ["dim", "band"]).withColumn(
        "q_block", F.concat_ws(":", "band", F.pmod(F.xxhash64("row"), F.col("n_blocks")))
    )
    packed = asked.groupBy("dim", "q_block").applyInPandas(_pack_queries, QUERIES)
    packed = cut(packed)
    # the buckets of a dimension, some hundreds at most; a block of queries meets only those whose vectors can reach its limit
    reached = F.when(F.col("need") > 0, F.floor(F.log("need") / float(np.log(RATIO))) - 1).otherwise(F.lit(-1)).cast("long")
    held = sizes.groupBy("dim").agg(F.collect_set("bucket").alias("buckets"))
    wanted = packed.select("dim", "q_block", "need", reached.alias("low")).join(held, "dim")
    wanted = wanted.select("dim", "q_block", "need", F.explode(F.filter("buckets", lambda b: b >= F.col("low"))).alias("bucket"))
    pairs = wanted.join(blocks.select("dim", "bucket", "block", "longest"), ["dim", "bucket"])
    pairs = pairs.filter(F.col("longest") * (1 + 1e-9) >= F.col("need")).select("dim", "q_block", "bucket", "block")
    work = pairs.join(packed.drop("need"), ["dim", "q_block"]).join(blocks.drop("n", "longest"), ["dim", "bucket", "block"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield _verify(row, k)

    found = work.select("dim", "q_rows", "q_ids", "q_vectors", "limits", "rows", "ids", "vectors")
    found = found.mapInArrow(verify, "query_row long, query_id long, vec_id long, score long, about double")
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), F.desc("about"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


QUERIES = "dim int, q_block string, need double, q_rows binary, q_ids binary, q_vectors binary, limits binary"


def _pack_queries(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame(
        {
            "dim": [int(key[0])],
            "q_block": [key[1]],
            "need": [float(rows["need"].min())],
            "q_rows": [rows["row"].to_numpy("<i8").tobytes()],
            "q_ids": [rows["vec_id"].to_numpy("<i8").tobytes()],
            "q_vectors": [np.stack(rows["v"].to_numpy()).astype("<f8").tobytes()],
            "limits": [rows["limit"].to_numpy("<f8").tobytes()],
        }
    )


def _verify(row: dict, k: int) -> pa.RecordBatch:
    """The k best of one block of vectors for each query of one block of queries, as far as they reach the query's limit."""
    dim = row["dim"]
    q_rows, q_ids, rows, ids = (np.frombuffer(row[c], "<i8") for c in ("q_rows", "q_ids", "rows", "ids"))
    queries = np.frombuffer(row["q_vectors"], "<f8").reshape(-1, dim)
    vectors = np.frombuffer(row["vectors"], "<f8").reshape(-1, dim)
    limits = np.frombuffer(row["limits"], "<f8")
    lengths, norms = (np.sqrt((x**2).sum(1)) for x in (queries, vectors))
    kept = [prune(q, n, t, vectors, norms) for q, n, t in zip(queries, lengths, limits, strict=True)]
    out: list[tuple] = []
    many = [i for i, at in enumerate(kept) if 4 * len(at) >= len(ids)]
    together = dict(zip(many, products(vectors, queries[many]).T, strict=True)) if many else {}
    for i, at in enumerate(kept):
        if not len(at):
            continue
        scores = together[i][at] if i in together else products(vectors[at], queries[i : i + 1])[:, 0]
        able = (scores >= limits[i]).astype(bool) & (rows[at] != q_rows[i])
        scores, own = scores[able], ids[at][able]
        for n in best(scores, own, k).tolist():
            exact = int(scores[n])
            out.append((int(q_rows[i]), int(q_ids[i]), int(own[n]), max(LEAST_SCORE, min(MOST_SCORE, exact)), float(exact)))
    names = ["query_row", "query_id", "vec_id", "score", "about"]
    columns = list(zip(*out)) if out else [[]] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, pa.float64() if n == "about" else pa.int64()) for n, c in zip(names, columns)], names)
