"""Audit of how filters interact: what each removes in every order, from one table of counts by failure mask.

A document's failures are a mask of bits, one for each filter. For a part of the corpus, let c(m) count the documents of mask m, and let
x be how far each filter is switched on. The documents removed are the multilinear polynomial

    R(x) = sum over m of c(m) * (1 - product over i in m of (1 - x_i)) = sum over T of a(T) * product over i in T of x_i,

with a(T) = (-1)^(|T| + 1) * (documents whose mask holds T). At a corner, where each x is 0 or 1, R is what these filters remove
together, in whatever order, so that what survives a step is a corner's value. A filter's Shapley value, its removals averaged over all
orders, is the integral of R's derivative along the diagonal: the sum over T with i of a(T) / |T|, an exact rational. Times
the number of orders it is a whole number.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from itertools import permutations
from math import factorial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.common import cut, hot_keys, spread_join, text_key

FILTERS = "ABCDE"
SPACE = r"[\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
COUNTS = ["all", "good", "toxic"]


def text_failures(text: Column) -> Column:
    """Bits of the filters A to D that a text fails: A under 50 words, B under 65 distinct words in 100, C over 5 capitals in 100 characters, D a character of `#$%&*|`."""
    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(text) - F.length(F.translate(text, UPPER, ""))
    fails = [n < 50, 100 * distinct < 65 * n, 100 * capitals > 5 * F.length(text), F.regexp_like(text, F.lit(r"[#$%&*|]"))]
    mask = F.lit(0)
    for k, f in enumerate(fails):
        mask = mask + F.when(f, 1 << k).otherwise(0)
    return mask


def failure_masks(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): documents of each part by the mask of failed filters; bit 4 is E, a text that a smaller doc_id has too.

    Texts leave their rows where they are read: a short row for each document, equal ones counted together, is all that is shuffled. The least id
    of each text meets the rows by text and id, so that many copies of a text are no hot key. Null texts are empty, and a null source is an empty part. A
    row without an id has no smaller id and no labels; rows of one id and text are no copies of each other. An id labelled twice
    is good, or toxic, if any label says so."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), text_key(text).alias("key"), text_failures(text).alias("mask"))
    rows = cut(rows.groupBy("doc_id", "part", "key", "mask").agg(F.count("*").alias("n")))
    first = rows.filter("doc_id IS NOT NULL").groupBy("key").agg(F.min("doc_id").alias("doc_id")).withColumn("__first", F.lit(True))
    # rows without an id meet nothing, and are dealt by their text
    slot = F.when(F.col("doc_id").isNull(), F.pmod(F.xxhash64("key"), F.lit(4096))).otherwise(F.lit(0)).cast("int")
    rows = rows.join(first, ["key", "doc_id"], "left").withColumn("__slot", slot)
    repeated = F.col("doc_id").isNotNull() & F.col("__first").isNull()
    rows = rows.withColumn("mask", F.col("mask") + F.when(repeated, 16).otherwise(0))
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality", "toxic").filter("doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("bad")
    )
    hot = hot_keys(rows.groupBy("doc_id", "__slot").agg(F.count("*").alias("n")), ["doc_id", "__slot"])
    rows = spread_join(rows, marks.withColumn("__slot", F.lit(0)), ["doc_id", "__slot"], hot, "left")
    lost = lambda c: F.sum(F.when(F.col(c) == 1, F.col("n")).otherwise(0))
    return rows.groupBy("part", "mask").agg(F.sum("n").alias("n"), lost("good").alias("good"), lost("bad").alias("toxic"))


def removal_polynomial(counts: list[int]) -> list[int]:
    """a(T) for each set T of filters (a mask), from the counts by mask."""
    holding = list(counts)
    for bit in (1 << k for k in range(len(counts).bit_length() - 1)):
        for m in range(len(counts)):
            if not m & bit:
                holding[m] += holding[m | bit]
    return [0] + [holding[t] if t.bit_count() % 2 else -holding[t] for t in range(1, len(counts))]


def corner_values(polynomial: list[int]) -> list[int]:
    """R at each corner: the sum of a(T) over the sets T within it."""
    out = list(polynomial)
    for bit in (1 << k for k in range(len(out).bit_length() - 1)):
        for m in range(len(out)):
            if m & bit:
                out[m] += out[m ^ bit]
    return out


def shapley_values(polynomial: list[int]) -> list[Fraction]:
    """Each filter's integral of its partial derivative along the diagonal."""
    filters = range(len(polynomial).bit_length() - 1)
    return [sum((Fraction(a, t.bit_count()) for t, a in enumerate(polynomial) if t >> k & 1), Fraction(0)) for k in filters]


def audit_part(counts: dict[str, list[int]]) -> pd.DataFrame:
    """All orders and steps of one part; `counts` are by mask: all documents, the good and the toxic ones."""
    size = len(FILTERS)
    everything, orders = (1 << size) - 1, factorial(size)
    polynomials = {c: removal_polynomial(counts[c]) for c in COUNTS}
    corners = {c: corner_values(p) for c, p in polynomials.items()}
    removed, total = corners["all"], sum(counts["all"])
    shapley = [int(orders * s) for s in shapley_values(polynomials["all"])]
    out = []
    for order in permutations(range(size)):
        name, before = "".join(FILTERS[k] for k in order), 0
        for step, k in enumerate(order, 1):
            after = before | 1 << k
            here = {c: v[after] - v[before] for c, v in corners.items()}
            out.append((name, step, total - removed[after], here["all"], removed[1 << k] - here["all"], removed[everything] - removed[everything ^ 1 << k], here["good"], here["toxic"], shapley[k]))
            before = after
    return pd.DataFrame(out, columns=["filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"])


SHAPE = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def audit_masks(masks: DataFrame) -> DataFrame:
    """The audit of `masks` (part, mask, n, good, toxic): one row for each part, order of the filters, and step. A part without documents has no rows."""
    held = [(c, column) for c, column in zip(COUNTS, ("n", "good", "toxic"), strict=True)]
    by_mask = [F.sum(F.when(F.col("mask") == m, F.col(column)).otherwise(0)).alias(f"{c}_{m}") for c, column in held for m in range(1 << len(FILTERS))]
    parts = masks.groupBy("part").agg(*by_mask)
    parts = parts.select("part", *[F.array(*[f"{c}_{m}" for m in range(1 << len(FILTERS))]).alias(c) for c in COUNTS])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in frames:
            for part, *counts in zip(rows["part"], *(rows[c] for c in COUNTS), strict=True):
                found = audit_part({c: np.asarray(n).tolist() for c, n in zip(COUNTS, counts, strict=True)})
                found.insert(0, "part", part)
                yield found

    return parts.mapInPandas(run, SHAPE)


def audit_filters(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """How the filters A to E interact on whole texts, for each source: (part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley).

    See `failure_masks` for nulls, repeated rows and labels. Other columns are ignored; an empty table gives no rows."""
    return audit_masks(failure_masks(documents, labels))
