"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic documents are the positive sample; an unlabelled sample of all documents is the other. The class
prior (the share of toxic documents) corrects the risk: with losses of the positives as positive (Rp+) and as negative (Rp-),
and of the unlabelled as negative (Ru-), the risk is prior * Rp+ + max(0, Ru- - prior * Rp-); where
the second part falls below 0, the step goes against its gradient instead. The classifier is linear
over a document's distinct features: each word, its first four, five and six letters, and once more those beginnings that make up one in DENSE of
its words or more, all as 32-bit hashes. Features are counted in Spark, and those that the two samples tell apart at a fixed false-discovery rate take part, so that the
gate follows the samples' size. Only these features' marks in the sampled documents, a bitmap each, reach the driver.

The logistic loss orders the documents well, but its least risk draws their scores below one half, as positives are few and weights are held small. So the bias is set by the
same risk with the zero-one loss: the score of one half lies where prior * (share of positives missed) + max(0, share of unlabelled called
toxic - prior * share of positives found) is least. Here the unlabelled are documents that have a label, which is not looked at: of them alone the prior is known
exactly, while that of a sample of all documents differs from it by chance, and by as much the bias would be off.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.common import drop_stored, stored

WORD = re.compile(r"[^\W\d_]+")
#: Share of chance finds allowed among the chosen features (Benjamini and Hochberg).
FALSE_DISCOVERY = 0.01
#: A beginning is dense in a document if one in so many of its words has it.
DENSE = 128
#: Distinct words whose features or weights a task keeps at once.
KEPT_WORDS = 500_000
ROWS = 256


def _number(feature: str) -> int:
    return zlib.crc32(feature.encode())


class _Memo(dict):
    """word -> make(word), forgetting all when full."""

    def __init__(self, make):
        self.make = make

    def __missing__(self, word: str):
        if len(self) >= KEPT_WORDS:
            self.clear()
        self[word] = out = self.make(word)
        return out


def word_features(word: str) -> tuple[tuple[int, ...], tuple[int, ...]]:
    """A word's features, and those that count if they are dense."""
    begins = [f"{n}{word[:n]}" for n in (4, 5, 6) if len(word) >= n]
    return tuple(map(_number, ["w" + word, *begins])), tuple(_number("d" + x) for x in begins)


def document_features(words: Counter, features) -> set[int]:
    """The distinct features of a document's words."""
    plain, often = set(), Counter()
    for word, n in words.items():
        own, dense = features[word]
        plain.update(own)
        for x in dense:
            often[x] += n
    total = words.total()
    return plain | {x for x, n in often.items() if n * DENSE >= total}


def words_of(text: str) -> Counter:
    return Counter(WORD.findall(text.lower()))


@dataclass(frozen=True)
class ToxicityModel:
    """Weights of the chosen features, and the bias; `score` is the logistic of their sum over a document's distinct features."""

    weights: dict[int, float]
    bias: float

    def chosen(self, word: str) -> tuple[tuple[int, ...], tuple[int, ...]]:
        return tuple(tuple(x for x in own if x in self.weights) for own in word_features(word))

    def score(self, words: Counter, chosen) -> float:
        found = sorted(document_features(words, chosen))
        return 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, sum(self.weights[x] for x in found) + self.bias))))


def nnpu_risk(z: np.ndarray, k: int, prior: float) -> tuple[float, np.ndarray]:
    """The non-negative risk of scores `z`, the first k of positives and the rest of unlabelled documents, and the slopes that a step goes
    down: those of the risk, and, where the negative part has fallen below 0, the opposite of that part's."""
    p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    as_negative = np.logaddexp(0, z)
    own, rest = as_negative[:k], as_negative[k:]
    excess = rest.mean() - prior * own.mean()
    slope = np.empty(len(z))
    if excess >= 0:
        slope[:k] = prior * (p[:k] - 1) / k - prior * p[:k] / k
        slope[k:] = p[k:] / len(rest)
    else:
        slope[:k] = prior * p[:k] / k
        slope[k:] = -p[k:] / len(rest)
    return float(prior * np.logaddexp(0, -z[:k]).mean() + max(0.0, excess)), slope


def train_nnpu(
    marks: np.ndarray, positive: np.ndarray, prior: float, epochs: int = 60, batch: int = 512, rate: float = 0.03, decay: float = 0.0005, seed: int = 7
) -> tuple[np.ndarray, float]:
    """(weights, bias) from sampled documents. `marks`: a row of packed bits for each document, a bit for each feature;
    `positive` marks the confirmed ones and the rest are unlabelled. The loss is logistic and the steps are Adam's.
    Without positives, or with nothing else, all scores are near 0."""
    size = marks.shape[1] * 8
    if not positive.any() or positive.all() or not 0 < prior < 1:
        return np.zeros(size), -30.0
    rng = np.random.default_rng(seed)
    found = [np.flatnonzero(np.unpackbits(row)) for row in marks]
    counts = np.array([len(d) for d in found])
    ends = np.cumsum(counts)
    flat = np.concatenate(found)
    marked, rest = np.flatnonzero(positive), np.flatnonzero(~positive)
    weights, first, second = np.zeros(size + 1), np.zeros(size + 1), np.zeros(size + 1)  # the last is the bias
    weights[-1] = np.log(prior / (1 - prior))
    steps = max(epochs * math.ceil(len(rest) / batch), MIN_STEPS)
    queue = np.zeros(0, np.int64)
    for step in range(1, steps + 1):
        if len(queue) < min(batch, len(rest)):
            queue = np.concatenate([queue, rng.permutation(rest)])
        unlabelled, queue = queue[:batch], queue[batch:]
        own = rng.choice(marked, min(len(marked), batch // 2), replace=False)
        rows = np.concatenate([own, unlabelled])
        n = counts[rows]
        begins = np.cumsum(n) - n
        features = flat[np.repeat(ends[rows] - n - begins, n) + np.arange(n.sum())]
        row_of = np.repeat(np.arange(len(rows)), n)
        z = np.bincount(row_of, weights[features], len(rows)) + weights[-1]
        slope = nnpu_risk(z, len(own), prior)[1]
        gradient = np.empty(size + 1)
        gradient[:-1] = np.bincount(features, slope[row_of], size) + decay * weights[:-1]
        gradient[-1] = slope.sum()
        first = 0.9 * first + 0.1 * gradient
        second = 0.999 * second + 0.001 * gradient * gradient
        now = rate * min(1.0, 2 * (1 - step / (steps + 1)))  # falls to nothing over the second half
        weights -= now * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return weights[:-1], float(weights[-1])


#: Steps of a training at least, so that a small sample is learned as far as a large one.
MIN_STEPS = 600


def least_risk_bias(positive: np.ndarray, unlabelled: np.ndarray, prior: float, bias: float) -> float:
    """The bias with the least zero-one risk, from the two samples' sums of weights. Between two neighbouring sums it lies in the middle;
    it stays `bias` where calling none toxic has no greater risk."""
    values = np.unique(np.concatenate([positive, unlabelled]))[::-1]
    if not len(positive) or not len(unlabelled):
        return bias
    found, called = (1 - np.searchsorted(np.sort(x), values) / len(x) for x in (positive, unlabelled))
    risk = prior * (1 - found) + np.maximum(0, called - prior * found)
    best = int(np.argmin(risk))
    if risk[best] >= prior or best + 1 == len(values):
        return bias
    return float(-(values[best] + values[best + 1]) / 2)


def held_out(doc_id) -> F.Column:
    """crc32 of the id as text, modulo 5, is 0. A null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _sample_features(sample: DataFrame) -> DataFrame:
    """(doc_id, toxic, key, features) of the sampled rows; `key` orders rows of one id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _Memo(word_features)
        for batch in batches:
            for at in range(0, len(batch), ROWS):
                part = batch.slice(at, ROWS)
                found = [sorted(document_features(words_of(t or ""), memo)) for t in part["text"].to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part["doc_id"], part["toxic"], part["key"], pa.array(found, pa.list_(pa.int64()))], ["doc_id", "toxic", "key", "features"]
                )

    found = sample.mapInArrow(run, "doc_id long, toxic int, key long, features array<long>")
    # one row for each id, however often the id stands in the table
    return found.groupBy("doc_id", "toxic").agg(F.min(F.struct("key", "features")).alias("row")).select("toxic", "row.key", "row.features")


#: The `toxic` column of the sample; the last two are the documents that the bias is set on, of which the prior is counted.
POSITIVE, UNLABELLED, JUDGED, JUDGED_TOXIC = 1, 0, 2, 3


def choose_features(sample: DataFrame, n_positive: int, n_other: int, width: int) -> np.ndarray:
    """The features, sorted, that stand in a larger share of the positives than of the others; at most `width` of them, the best, reach the driver."""
    if not n_positive or not n_other:
        return np.zeros(0, np.int64)
    counts = sample.filter("toxic < 2").select("toxic", F.explode("features").alias("feature")).groupBy("feature").agg(
        F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b")
    )
    n, m = float(n_positive), float(n_other)
    pooled = (F.col("a") + F.col("b")) / (n + m)
    error = F.sqrt(F.greatest(pooled * (1 - pooled), F.lit(1e-12)) * (1 / n + 1 / m))
    stands = counts.withColumn("z", (F.col("a") / n - F.col("b") / m) / error)
    tested = counts.count()
    best = stands.filter("z > 0").orderBy(F.desc("z"), "feature").limit(width).select("feature", "z").collect()
    kept = 0
    for rank, row in enumerate(best, 1):
        if math.erfc(row.z / math.sqrt(2)) / 2 <= FALSE_DISCOVERY * rank / tested:
            kept = rank
    return np.sort(np.array([r.feature for r in best[:kept]], np.int64))


def fit_toxicity(documents: DataFrame, labels: DataFrame, max_positive: int = 4000, max_unlabelled: int = 8000, max_judged: int = 4000, width: int = 4096) -> ToxicityModel:
    """Trains on the rows of `documents` that are not held out.

    Positives are up to `max_positive` documents with a toxic label of 1, and the unlabelled sample is up to `max_unlabelled`
    documents whatever their label; the bias is set on up to `max_judged` documents that have a label. All are drawn by a hash of the id, and of the rows of one id the text of least hash stands for all. So the sample is bounded in rows,
    the model in features (`width`, the best by their standard errors), and what reaches the driver in bytes: `width` bits a row.
    The prior is the share of toxic among all labelled documents not held out; where an id is labelled twice, toxic counts.
    Labels and ids choose the sample; the features are of the whole texts alone. Null texts count as empty; rows without an id,
    other columns and null labels take no part. With an empty table, no positives or nothing else, all scores are near 0.
    """
    spark = documents.sparkSession
    docs = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).filter(~held_out(F.col("doc_id")))
    known = labels.select(F.col("doc_id").cast("long"), "toxic").filter(~held_out(F.col("doc_id")) & F.col("toxic").isNotNull())
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    share = known.agg(F.avg((F.col("toxic") == 1).cast("double")).alias("p")).first().p or 0.0
    drawn = F.xxhash64(F.lit("sample"), "doc_id")
    ids = docs.select("doc_id").filter("doc_id IS NOT NULL").distinct()
    toxic_ids = known.filter("toxic = 1").join(ids, "doc_id", "left_semi").select("doc_id").orderBy(drawn, "doc_id").limit(max_positive)
    other_ids = ids.orderBy(drawn, "doc_id").limit(max_unlabelled)
    judged = known.join(ids, "doc_id", "left_semi").orderBy(drawn, "doc_id").limit(max_judged)
    judged = judged.select("doc_id", F.when(F.col("toxic") == 1, JUDGED_TOXIC).otherwise(JUDGED).alias("toxic"))
    chosen = toxic_ids.withColumn("toxic", F.lit(POSITIVE)).unionByName(other_ids.withColumn("toxic", F.lit(UNLABELLED))).unionByName(judged)
    # the chosen ids are max_positive + max_unlabelled + max_judged at most
    sample = docs.join(F.broadcast(chosen), "doc_id").select("doc_id", "toxic", F.xxhash64("text").alias("key"), "text")
    sample, path = stored(_sample_features(sample), "toxicity-sample")
    sizes = {r.toxic: r.n for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    features = choose_features(sample, sizes.get(POSITIVE, 0), sizes.get(UNLABELLED, 0), width)
    shared = spark.sparkContext.broadcast(features)  # `width` numbers at most

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            rows = [np.packbits(np.isin(own, np.asarray(x, np.int64), assume_unique=True)).tobytes() for x in batch["features"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["toxic"], pa.array(rows, pa.binary())], ["toxic", "marks"])

    rows = sample.mapInArrow(mark, "toxic int, marks binary").toArrow().sort_by([("toxic", "ascending"), ("marks", "ascending")])
    drop_stored(spark, path)  # the order is the same however the rows arrived
    n_bytes = (len(features) + 7) // 8
    marks = np.frombuffer(b"".join(rows["marks"].to_pylist()), np.uint8).reshape(len(rows), n_bytes)
    part = np.array(rows["toxic"].to_pylist(), np.int64)
    weights, bias = train_nnpu(marks[part < JUDGED], part[part < JUDGED] == POSITIVE, share)
    totals = np.array([weights[: 8 * n_bytes] @ np.unpackbits(row) for row in marks])
    own = float(np.mean(part[part >= JUDGED] == JUDGED_TOXIC)) if (part >= JUDGED).any() else share
    bias = least_risk_bias(totals[part == POSITIVE], totals[part >= JUDGED], own, bias)
    return ToxicityModel(dict(zip(features.tolist(), weights.tolist())), bias)


def scorer(spark, model: ToxicityModel):
    """A column function: the score of a text, 0 to 1."""
    shared = spark.sparkContext.broadcast(model)  # `width` weights at most

    @F.pandas_udf("double")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = shared.value
        chosen = _Memo(own.chosen)
        for texts in parts:
            yield pd.Series([own.score(words_of(t or ""), chosen) for t in texts], dtype=float)

    return lambda text: score(text.cast("string"))


def score_toxicity(documents: DataFrame, model: ToxicityModel, threshold: float = 0.5) -> DataFrame:
    """All columns of `documents`, with `score` (double, 0 to 1) and `predicted` (score >= threshold) appended,
    replacing columns of these names. Each row's whole text is read; null and empty texts have the bias's score.
    Equal texts have equal scores, and repeated rows are kept. An empty table gives no rows."""
    scored = documents.withColumn("score", scorer(documents.sparkSession, model)(F.col("text")))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
