"""Best-fit packing of tokenised documents by length patterns.

The tokens of a document give one piece shorter than a sequence, and whole sequences. Only the histogram of
the short pieces' lengths (fewer bins than a sequence has tokens) goes to the driver. There, patterns of two
and three lengths that fill a sequence exactly are enumerated, their repeat counts are fitted to the histogram
by non-negative least squares, rounded down, and clipped to what is left; the residual lengths are packed
best-fit, the longest first, again by pattern and repeat count. The plan is as small as the number of
patterns, however many documents there are. Each piece finds its place by its rank among those of its length.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.llm.bpe import load_vocabulary
from scriptorium.llm.common import cut

#: A run of white space this long goes to the slower tokenizer; the faster one's pattern matcher overflows on some.
LONG_SPACE = re.compile(r"\s{2000}")
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def piece_bounds(n: int, size: int) -> Iterator[tuple[int, int]]:
    """(start, end) of a document's pieces: the first has the remainder, if any, and the others are full."""
    first = n % size or min(n, size)
    yield 0, first
    for at in range(first, n, size):
        yield at, at + size


def fit_patterns(counts: np.ndarray, patterns: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Non-negative least squares: repeats x of the patterns (rows of up to three lengths, 0 for none) so that the
    lengths they use come near `counts`. Accelerated projected gradient; each round is a few passes over the patterns."""
    weights = (patterns > 0).astype(float)
    size = len(counts)
    flat = patterns.ravel()

    def used(x: np.ndarray) -> np.ndarray:
        out = np.bincount(flat, (weights * x[:, None]).ravel(), size)
        out[0] = 0
        return out

    reach = np.bincount(flat, weights.ravel(), size)
    step = 1.0 / max(1.0, (weights * reach[patterns]).sum(1).max())  # a bound on the largest eigenvalue
    x = look = np.zeros(len(patterns))
    momentum = 1.0
    for _ in range(rounds):
        gradient = ((used(look) - counts)[patterns] * weights).sum(1)
        new = np.maximum(0.0, look - step * gradient)
        after = (1 + (1 + 4 * momentum * momentum) ** 0.5) / 2
        look = new + (momentum - 1) / after * (new - x)
        x, momentum = new, after
    return x


def exact_patterns(counts: np.ndarray, size: int) -> np.ndarray:
    """All patterns of two or three lengths in the histogram that add up to `size`, as rows (a >= b >= c, c may be 0)."""
    have = np.flatnonzero(counts)
    a, b = np.meshgrid(have, have, indexing="ij")
    keep = (a >= b) & (a + b <= size)
    a, b = a[keep], b[keep]
    c = size - a - b
    fits = (c == 0) | ((c > 0) & (c <= b) & (counts[np.maximum(c, 0)] > 0))
    return np.stack([a[fits], b[fits], c[fits]], 1)


def plan_packing(histogram: dict[int, int], size: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of one sequence, the number of such sequences), for all lengths of the histogram."""
    counts = np.zeros(size + 1, np.int64)
    for length, n in histogram.items():
        counts[length] += n
    plan = [((size,), int(counts[size]))] if counts[size] else []
    counts[size] = 0
    patterns = exact_patterns(counts, size)
    if len(patterns):
        repeats = np.floor(fit_patterns(counts[:size].astype(float), patterns) + 1e-6).astype(np.int64)
        for k in np.argsort(-repeats, kind="stable").tolist():
            if repeats[k] == 0:
                break
            lengths = tuple(x for x in patterns[k].tolist() if x)
            n = min(int(repeats[k]), *(int(counts[x]) // lengths.count(x) for x in set(lengths)))
            if n > 0:
                plan.append((lengths, n))
                for x in lengths:
                    counts[x] -= n
    left = [x for x in range(size - 1, 0, -1) if counts[x]]
    while left:
        pattern, room = [], size
        for x in left:  # the longest that fits, again and again
            n = min(room // x, int(counts[x]))
            pattern += [x] * n
            room -= n * x
        n = min(int(counts[x]) // pattern.count(x) for x in set(pattern))
        plan.append((tuple(pattern), n))
        for x in pattern:
            counts[x] -= n
        left = [x for x in left if counts[x]]
    return plan


@lru_cache(maxsize=1)
def _tokenizers(json_path: str, ranks_path: str | None, pattern: str | None):
    """(the tokenizer, what finds texts that only it may take, the same ids by ranks)."""
    from tokenizers import Tokenizer

    named = Tokenizer.from_file(json_path)
    if ranks_path is None:
        return named, None, None
    import tiktoken

    ranks = load_vocabulary(ranks_path).ranks
    added = [t.content for t in named.get_added_tokens_decoder().values()]
    alone = re.compile("|".join([LONG_SPACE.pattern, *map(re.escape, added)]))
    return named, alone, tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def tokenise(text: str, json_path: str, ranks_path: str | None, pattern: str | None) -> list[int]:
    """The ids of the tokenizer at `json_path`, called plainly with add_special_tokens=False."""
    named, alone, fast = _tokenizers(json_path, ranks_path, pattern)
    if fast is None or alone.search(text):
        return named.encode(text, add_special_tokens=False).ids
    return fast.encode_ordinary(text)


def token_pieces(
    documents: DataFrame, json_path: str, end_id: int = 2, size: int = 1024, ranks_path: str | None = None, pattern: str | None = None, with_ids: bool = False
) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of each row's pieces: its ids, then `end_id`.

    `json_path` is the tokenizer; where its vocabulary also exists as ranks with a splitting pattern, the same ids
    come faster from `ranks_path` and `pattern` (by tiktoken; texts that hold the string of an added token, or white space too long for
    its pattern matcher, go to the tokenizer itself). Null text counts as empty: one piece of one id. The string of an
    added token becomes its id, as the plain call has it. Repeated rows give repeated pieces, an empty table none;
    texts of any length are taken whole, and other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, len(batch), 512):
                part = batch.slice(first, 512)
                rows = []
                for doc_id, text in zip(part["doc_id"].to_pylist(), part["text"].to_pylist(), strict=True):
                    ids = np.array(tokenise(text or "", json_path, ranks_path, pattern) + [end_id], "<u4")
                    for k, (a, b) in enumerate(piece_bounds(len(ids), size)):
                        own = ids[a:b]
                        rows.append((doc_id, k, a, b - a, zlib.crc32(own), own.astype(np.int32)) if with_ids else (doc_id, k, a, b - a, zlib.crc32(own)))
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
                columns = [pa.array(c, kind) for c, kind in zip(zip(*rows), kinds)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: len(columns)])

    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, PIECES + ", ids array<int>" * with_ids)


def pack_pieces(pieces: DataFrame, size: int = 1024) -> DataFrame:
    """`pieces` with sequence_id and offset, in as few sequences of `size` tokens as the plan finds.

    Pieces of one length are ranked by doc_id, piece and checksum (equal rows in any order) without bringing
    them all together: they are dealt by hash over about as many blocks as a block has rows, and a block's ranks start after the
    earlier blocks' counts. An empty table gives an empty table.
    """
    pieces = cut(pieces)
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    plan = plan_packing(histogram, size)
    slots, used, sequences = [], {}, 0
    for lengths, n in plan:
        at = 0
        for length in lengths:
            first = used.get(length, 0)
            slots.append((length, first, sequences, at))
            used[length] = first + n
            at += length
        sequences += n
    slots.sort()
    lengths, firsts, bases, offsets = (np.array(x, np.int64) for x in (zip(*slots) if slots else ([], [], [], [])))
    wide = np.int64(1 << 48)
    keys = lengths * wide + firsts

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        at = np.searchsorted(keys, length.to_numpy(np.int64) * wide + rank.to_numpy(np.int64), "right") - 1
        return pd.DataFrame({"sequence_id": bases[at] + rank.to_numpy(np.int64) - firsts[at], "offset": offsets[at]})

    n_blocks = max(1, int(max(histogram.values(), default=1) ** 0.5))
    dealt = pieces.withColumn("__block", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(n_blocks)).cast("int"))
    earlier = Window.partitionBy("length").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("length", "__block").agg(F.count("*").alias("n")).select(
        "length", "__block", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("__first")
    )
    own = Window.partitionBy("length", "__block").orderBy("doc_id", "piece", "ids_crc32")
    ranked = dealt.withColumn("__own", F.row_number().over(own) - 1).join(starts, ["length", "__block"])
    return ranked.withColumn("__place", place("length", F.col("__first") + F.col("__own"))).select(
        *[c for c in pieces.columns], "__place.sequence_id", "__place.offset"
    )
