"""Substring deduplication by hashing lines, the sentences in them, and short ones joined with their neighbours.

A text's lines are cut at sentence ends. A unit is a line of at least `line_words` words, or the shortest run of neighbouring sentences that has at least
`min_words` words, or a whole text that is shorter than such a run. A run begins or ends at each sentence, and a long sentence is a run by itself, so no
text lies outside all units. Every stretch of whole sentences with `min_words` words, so
every paragraph too, is covered by the units that lie in it. Units are normalised and hashed with their
offsets, and the digests are grouped over all documents; the occurrence that ranks first (least doc_id, then text key,
then offset) stays, and the others are cut out of their texts. What was cut is told as offsets into the original text.

Each cut character stands in an occurrence that ranks earlier. If it is cut there too, then by one that ranks earlier
still, so something of each repeat always stays.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.common import cut, free_name, hot_keys, spread_join, text_key

SENTENCE_END = re.compile(r"[.!?]+\s+|[。！？]+\s*")
#: Thai, Lao, Myanmar, Khmer, kana and ideographs: scripts without spaces, each character of which counts as a word.
SPACELESS = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")
ROWS = 512
MIN_WORDS, LINE_WORDS = 15, 10


def count_words(words: list[str]) -> int:
    joined = "".join(words)
    return len(words) if joined.isascii() else len(words) + len(SPACELESS.findall(joined))


def sentences(text: str) -> tuple[list[tuple[int, int, str, int]], list[tuple[int, int]]]:
    """((start, end, normalised, words) of each sentence, the first and last sentence of each line). Blank ones are left out."""
    found: list[tuple[int, int, str, int]] = []
    lines, at = [], 0
    for line in text.split("\n"):
        first, begin = len(found), 0
        for end in [*(m.end() for m in SENTENCE_END.finditer(line)), len(line)]:
            words = line[begin:end].lower().split()
            if words:
                found.append((at + begin, at + end, " ".join(words), count_words(words)))
            begin = end
        if len(found) > first:
            lines.append((first, len(found) - 1))
        at += len(line) + 1
    return found, lines


def units(text: str, min_words: int, line_words: int = LINE_WORDS) -> list[tuple[int, int, str]]:
    """(start, end, normalised) of each unit, each once. A span is without the line break at its end."""
    found, lines = sentences(text)
    upto = [0, *accumulate(x[3] for x in found)]
    runs = {(a, b) for a, b in lines if upto[b + 1] - upto[a] >= min(min_words, line_words)}
    if found and upto[-1] < min_words:
        runs.add((0, len(found) - 1))
    for k in range(len(found)):
        b = bisect_left(upto, upto[k] + min_words) - 1  # the run that begins here
        if b < len(found):
            runs.add((k, b))
        a = bisect_right(upto, upto[k + 1] - min_words) - 1  # the run that ends here
        if a >= 0:
            runs.add((a, k))
    return [(found[a][0], found[b][1], found[a][2] if a == b else " ".join([x[2] for x in found[a : b + 1]])) for a, b in runs]


DIGEST = ["d1", "d2"]
#: Bits of the filter of digests that may repeat: a fixed size, so past some number of digests it only lets all pass.
FILTER_BITS = 26


def unit_digests(keyed: DataFrame, min_words: int, line_words: int, bitmap=None) -> DataFrame:
    """The digest (d1, d2) of each unit; with a broadcast `bitmap`, also doc_id, text_key, start and end, of the units whose digest's bit is set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), ROWS):
                part = batch.slice(at, ROWS)
                of, starts, ends, digests = [], [], [], []
                for k, text in enumerate(part["text"].to_pylist()):
                    for start, end, unit in units(text or "", min_words, line_words):
                        of.append(k)
                        starts.append(start)
                        ends.append(end)
                        digests.append(hashlib.blake2b(unit.encode(), digest_size=16).digest())
                pairs = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
                if bitmap is None:
                    yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], DIGEST)
                    continue
                bit = pairs[:, 0] & ((1 << FILTER_BITS) - 1)
                may = np.flatnonzero(bitmap.value[bit >> 5] >> (bit & 31).astype(np.uint32) & 1)
                own = pa.array(np.array(of, np.int32)[may])
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array(pairs[may, c]) for c in (0, 1)), part["doc_id"].take(own), part["text_key"].take(own), pa.array(np.array(starts, np.int32)[may]), pa.array(np.array(ends, np.int32)[may])],
                    [*DIGEST, "doc_id", "text_key", "start", "end"],
                )

    shape = "d1 long, d2 long" + ", doc_id long, text_key binary, start int, end int" * (bitmap is not None)
    return keyed.mapInArrow(run, shape)


def repeated_bits(keyed: DataFrame, min_words: int, line_words: int):
    """A broadcast bitmap of 2 ** FILTER_BITS bits, one set for each digest that occurs more than once; words of it are all that reaches the driver."""
    repeated = unit_digests(keyed.select("text"), min_words, line_words).groupBy(*DIGEST).agg(F.count("*").alias("n")).filter("n > 1")
    return bits_of(repeated, F.col("d1").bitwiseAND((1 << FILTER_BITS) - 1))


def bits_of(rows: DataFrame, bit):
    """A broadcast bitmap of 2 ** FILTER_BITS bits, with those set that `rows` have."""
    word = rows.select(F.shiftright(bit, 5).alias("word"), bit.bitwiseAND(31).cast("int").alias("bit"))
    words = word.groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits")).toArrow()
    bitmap = np.zeros(1 << (FILTER_BITS - 5), np.int64)
    bitmap[words["word"].to_numpy()] = words["bits"].to_numpy()
    return rows.sparkSession.sparkContext.broadcast(bitmap.astype(np.uint32))


def merge_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def cut_spans(text: str, spans: list[tuple[int, int]]) -> tuple[str, list[tuple[int, int]]]:
    """The text without the spans, and the spans as cut: merged, and with the line break of a line that goes whole."""
    spans = merge_spans(spans)
    widened = []
    for a, b in spans:
        if (a == 0 or text[a - 1] == "\n") and b < len(text) and text[b] == "\n":
            b += 1
        elif b == len(text) and a > 0 and text[a - 1] == "\n":
            a -= 1
        widened.append((a, b))
    widened = merge_spans(widened)
    kept, at = [], 0
    for a, b in widened:
        kept.append(text[at:a])
        at = b
    return "".join(kept) + text[at:], widened


def _cut(texts: pd.Series, spans: pd.Series) -> pd.DataFrame:
    found = [
        (text, []) if spans is None or text is None else cut_spans(text, [(x["start"], x["end"]) for x in spans])
        for text, spans in zip(texts, spans, strict=True)
    ]
    return pd.DataFrame({"text": [x[0] for x in found], "spans": [[{"start": a, "end": b} for a, b in x[1]] for x in found]})


def dedup_units(documents: DataFrame, min_words: int = MIN_WORDS, spans_col: str = "removed_spans", line_words: int = LINE_WORDS) -> DataFrame:
    """All columns of `documents`, `text` without its repeated units, and `spans_col` appended: what was cut, as
    [start, end) in characters of the original text (a column of this name is replaced).

    Units are equal if their lower-cased words are; see above for what a unit is. Of equal units the
    first by doc_id (null first), text key and offset stays. Equal rows (same id and text) are one document: all of
    them keep or lose the same. Null texts stay null and empty texts empty, with no spans; no row is dropped, and an empty table
    stays empty. Texts of any length are read whole. Other columns pass unchanged, whatever their names. Documents that lose nothing are not shuffled, but for
    those that a bitmap takes for others.
    """
    keyed = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("text_key"), F.col("text").cast("string").alias("text"))
    found = cut(unit_digests(keyed, min_words, line_words, repeated_bits(keyed, min_words, line_words)))
    place = F.struct("doc_id", "text_key", "start")
    first = found.groupBy(*DIGEST).agg(F.min(place).alias("first"), F.max(place).alias("last"), F.count("*").alias("n"))
    first = cut(first.filter("first <> last").select(*DIGEST, "first", "n"))
    repeats = spread_join(found, first.drop("n"), DIGEST, hot_keys(first, DIGEST)).filter(place > F.col("first"))
    own_key, own_spans, own_cut = (free_name(x, documents) for x in ("key", "spans", "cut"))
    row_key = lambda doc_id, key: F.unhex(F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("-")).cast("binary"), F.lit(b":"), key)))
    spans = repeats.groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("start", "end")).alias(own_spans))
    spans = cut(spans.select(row_key(F.col("doc_id"), F.col("text_key")).alias(own_key), own_spans))
    shared = bits_of(spans, F.pmod(F.xxhash64(own_key), F.lit(1 << FILTER_BITS)))

    @F.pandas_udf("boolean")
    def may_lose(bits):
        x = bits.to_numpy(np.int64)
        return pd.Series((shared.value[x >> 5] >> (x & 31).astype(np.uint32)) & 1 == 1)

    own_flag = free_name("may", documents)
    told = documents.withColumn(own_key, row_key(F.col("doc_id").cast("long"), text_key(F.col("text"))))
    told = told.withColumn(own_flag, may_lose(F.pmod(F.xxhash64(own_key), F.lit(1 << FILTER_BITS))))
    names = [c for c in documents.columns if c != spans_col]
    row = F.struct(*[F.col(f"`{c}`").alias(c) for c in names])
    losing = told.filter(F.col(own_flag)).select(own_key, row.alias(own_flag))
    sizes = losing.groupBy(own_key).agg(F.count("*").alias("n"))
    marked = spread_join(losing, spans, [own_key], hot_keys(sizes, [own_key]), "left")
    marked = marked.withColumn(own_cut, F.pandas_udf(_cut, "text string, spans array<struct<start:int,end:int>>")(F.col(f"{own_flag}.text").cast("string"), own_spans))
    kept = {c: F.col(own_flag)[c].alias(c) for c in names} | {"text": F.col(f"{own_cut}.text").alias("text")}
    changed = marked.select(*[kept[c] for c in names], F.col(f"{own_cut}.spans").alias(spans_col))
    none = F.array().cast("array<struct<start:int,end:int>>")
    same = told.filter(~F.col(own_flag)).select(*[F.col(f"`{c}`").cast("string").alias(c) if c == "text" else F.col(f"`{c}`") for c in names], none.alias(spans_col))
    return same.unionByName(changed)
