"""Removal of repeated substrings by names of growing lengths over sampled positions.

This is not prefix doubling: nothing ranks positions by sorted pairs. Positions are grouped by names (hashes) of ever longer strings
at them, and drop out once they are unique or past LENGTH bytes. Ranks of every byte position at every doubling would need a row of some 40 bytes for
each byte of text, so the positions are sampled first and become single only where that is needed:

1. Of each string of LENGTH bytes, the place of its least named substring of `GRAM` bytes is its anchor. Equal strings have their
   anchors at equal offsets, and an anchor serves a run of consecutive strings. Anchors with equal GRAM bytes are a
   family; those that stand nowhere else are unique, and so are all their strings.
2. Within a family, hulls are grouped, a hull being all strings of an anchor's run together: if it repeats, all its strings do. Families with
   hulls that differ, one of them single, stay open, and of equal hulls one stays as a source.
3. Open runs are cut at a fixed grid of `STEP` offsets. Within a family, cells are grouped by core, the LENGTH - STEP + 1 bytes that all strings of
   a cell share: unique ones drop out, and open ones are families anew, by core, of which the cells' hulls are grouped.
4. Within these families, the strings of LENGTH bytes of the single positions that are left are grouped.

Names of 1, 2, 4, ... 128 bytes come by doubling where the text is read, a name being that of the pair of its halves' names.
What decides a repeat is named twice with 64 bits, so equality is by 128 bits; texts are told apart by 128 bits (MD5 of
id and text). A family, hull or core that holds a great share of all rows is dealt over several tasks (`spread_join`).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.common import as_int64, cut, drop_stored, hot_keys, mix, small_batches, spread_join, stored

LENGTH, GRAM, STEP = 200, 64, 16
#: Bytes of text that a task names at once; a longer text goes in parts.
PART = 400_000
#: Bits of the filter of documents that are read again: a fixed size, so past some number of documents it only lets all pass.
FILTER_BITS = 26
#: Names of single bytes, for two independent names of each string.
_TABLES = np.random.default_rng(20240229).integers(0, 2**64, (2, 256), dtype=np.uint64)
_LOW = np.uint64(20)


class Names:
    """64-bit names of the substrings of some bytes."""

    def __init__(self, data: np.ndarray, which: int = 0):
        self.by_size = {1: _TABLES[which][data]}
        size = 1
        while size < 128:
            half = self.by_size[size]
            self.by_size[2 * size] = mix(half[:-size], half[size:]) if len(half) > size else half[:0]
            size *= 2
        for size in (1, 2, 4, 8, 16, 32):
            del self.by_size[size]

    def of(self, starts: np.ndarray, sizes) -> np.ndarray:
        """Names of the substrings of 129 to 384 bytes: of three that cover them, and their size."""
        names = self.by_size[128]
        out = mix(mix(names[starts], names[starts + (sizes - 128) // 2]), names[starts + sizes - 128])
        return mix(out, np.zeros(len(out), np.uint64) + np.asarray(sizes).astype(np.uint64))


def find_anchors(names: Names, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first start, last start) of each run of strings with one anchor. ends: for each byte, where its text ends."""
    count = len(ends) - LENGTH + 1
    if count <= 0:
        none = np.zeros(0, np.int64)
        return none, none, none
    grams = names.by_size[GRAM]
    width = LENGTH - GRAM + 1
    # the name's upper bits, then the place: the least is the leftmost of the least names
    least = (grams >> _LOW << _LOW) | np.arange(len(grams), dtype=np.uint64)
    size = 1
    while 2 * size <= width:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    least = np.minimum(least[:count], least[width - size : width - size + count])
    starts = np.flatnonzero(np.arange(count) + LENGTH <= ends[:count])
    if not len(starts):
        return starts, starts, starts
    anchor = (least[starts] & ((np.uint64(1) << _LOW) - np.uint64(1))).astype(np.int64)
    new = np.flatnonzero((anchor[1:] != anchor[:-1]) | (starts[1:] != starts[:-1] + 1)) + 1
    first = np.concatenate([[0], new])
    last = np.concatenate([new, [len(starts)]]) - 1
    return anchor[first], starts[first], starts[last]


def parts(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, list[tuple[int, int, int]]]]:
    """(bytes, each byte's end of text, [(text number, offset in the bytes, offset in the text)]) of runs of texts and parts of long ones.
    Each start of a string of LENGTH bytes is in one part."""
    run: list[tuple[int, int, bytes]] = []
    size = 0

    def packed():
        sizes = np.array([len(x) for _, _, x in run])
        ends = np.cumsum(sizes)
        data = np.frombuffer(b"".join(x for _, _, x in run), np.uint8)
        return data, np.repeat(ends, sizes), [(k, int(e - s), at) for (k, at, _), e, s in zip(run, ends, sizes, strict=True)]

    for k, text in enumerate(texts):
        for at in range(0, max(1, len(text) - LENGTH + 1), PART):
            own = text[at : at + PART + LENGTH - 1]
            if run and size + len(own) > PART:
                yield packed()
                run, size = [], 0
            run.append((k, at, own))
            size += len(own)
    if run:
        yield packed()


def _place(at: np.ndarray, before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """An anchor's offset and its run, as distances of the first and last starts before it, in one number."""
    return at << 16 | before << 8 | after


def place_span(place) -> tuple[F.Column, F.Column]:
    """[start, end) of the bytes under a run."""
    at = F.shiftright(place, 16)
    return at - F.shiftright(place, 8).bitwiseAND(255), at - place.bitwiseAND(255) + LENGTH


def hulls_of(data: np.ndarray, named: Names, starts: np.ndarray, sizes, mark: np.ndarray) -> list[pa.Array]:
    """The two names of substrings; `mark` is part of the name. `named` holds the first names of `data`."""
    mark = mark.astype(np.uint64)
    return [pa.array(as_int64(mix(names.of(starts, sizes), mark))) for names in (named, Names(data, 1))]


def anchor_rows(keyed: DataFrame, whole: bool) -> DataFrame:
    """The anchors' names `gram`; if `whole`, also the hull's names, key and place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch["key"] if whole else None
            texts = [(x or "").encode() for x in batch["text"].to_pylist()]
            for data, ends, held in parts(texts):
                names = Names(data)
                at, first, last = find_anchors(names, ends)
                columns = [pa.array(as_int64(names.by_size[GRAM][at]))]
                if whole:
                    columns += hulls_of(data, names, first, last - first + LENGTH, at - first) if len(at) else [pa.array([], pa.int64())] * 2
                    of = np.searchsorted([x[1] for x in held], first, "right") - 1
                    shift = np.array([x[2] - x[1] for x in held])[of]
                    own = pa.array(np.array([x[0] for x in held])[of])
                    columns += [keys.take(own), pa.array(_place(at + shift, at - first, at - last))]
                yield pa.RecordBatch.from_arrays(columns, ["gram", *HULL, "key", "place"][: len(columns)])

    shape = "gram long" + ", hull long, hull2 long, key binary, place long" * whole
    return (keyed if whole else keyed.select("text")).mapInArrow(run, shape)


class _Stored:
    """Tables written for one run. Joins with them are dealt anew on both sides, so that Spark can split a frequent key's partitions."""

    def __init__(self, spark):
        self.spark, self.paths = spark, []

    def __call__(self, df: DataFrame, name: str) -> DataFrame:
        df, path = stored(df, name)
        self.paths.append(path)
        return df

    def drop(self) -> None:
        for path in self.paths:
            drop_stored(self.spark, path)


def _numbered(groups: DataFrame, keys: list[str]) -> DataFrame:
    """Groups (keys..., n) with `number`, a short name of each, in no order. They are to be written once before the numbers are read."""
    return groups.select(*keys, "n").withColumn("number", F.monotonically_increasing_id())


def _hulls(rows: DataFrame, keys: list[str], weight, keep: _Stored) -> tuple[DataFrame, DataFrame]:
    """Of rows with `keys`, and HULL: the hulls that occur more than once (keys, HULL, n), one row for each hull of a
    group that holds several hulls and among them a single one, with the group's number, `family`, in place of the keys. Occurrences are sums of `weight`."""
    carried = [c for c in rows.columns if c not in (*keys, *HULL, "n")]
    hulls = keep(rows.groupBy(*keys, *HULL).agg(F.sum(weight).alias("n"), F.count("*").alias("n_rows"), F.min(F.struct(*carried)).alias("row")), "hulls")
    mixed = hulls.groupBy(*keys).agg(F.count("*").alias("n"), F.min("n").alias("m")).filter("n > 1 AND m = 1")
    mixed = keep(_numbered(mixed, keys), "mixed")
    open_rows = spread_join(hulls, mixed.drop("n"), keys, hot_keys(mixed, keys)).select(F.col("number").alias("family"), "n", "row.*")
    return keep(hulls.filter("n > 1").select(*keys, *HULL, F.col("n_rows").alias("n")), "repeated"), open_rows


def document_filter(keyed: DataFrame, wanted: DataFrame) -> DataFrame:
    """`keyed` without most of the documents that aren't in `wanted` (key): by a bitmap of 2 ** FILTER_BITS bits,
    which is all that reaches the driver. It lets all wanted ones pass; a join follows."""
    bit = F.pmod(F.xxhash64("key"), F.lit(1 << FILTER_BITS))
    word = wanted.select(F.shiftright(bit, 5).alias("word"), bit.bitwiseAND(31).cast("int").alias("bit"))
    words = word.groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits")).toArrow()
    bitmap = np.zeros(1 << (FILTER_BITS - 5), np.int64)
    bitmap[words["word"].to_numpy()] = words["bits"].to_numpy()
    shared = keyed.sparkSession.sparkContext.broadcast(bitmap.astype(np.uint32))

    @F.pandas_udf("boolean")
    def may(bits):
        x = bits.to_numpy(np.int64)
        return bits.__class__((shared.value[x >> 5] >> (x & 31).astype(np.uint32)) & 1 == 1)

    # rows that are equal in id and text are read once
    return keyed.filter(may(bit)).groupBy("key").agg(F.first("text").alias("text"))


HULL = ["hull", "hull2"]
ITEM = ["family", "n", "key", "place"]


def item_bytes(keyed: DataFrame, items: DataFrame) -> DataFrame:
    """`items` with `bytes`, the bytes under their runs, read from their documents."""
    wanted = cut(items.groupBy("key").agg(F.collect_list(F.struct("family", "n", "place")).alias("items")))
    read = document_filter(keyed, wanted).join(wanted, "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                text = (batch["text"][k].as_py() or "").encode()
                rows = batch["items"][k].as_py()
                places = [x["place"] for x in rows]
                own = [text[(p >> 16) - (p >> 8 & 255) : (p >> 16) - (p & 255) + LENGTH] for p in places]
                one = pa.array([k] * len(rows), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x["family"] for x in rows], pa.int64()), pa.array([x["n"] for x in rows], pa.int64()), batch["key"].take(one), pa.array(places, pa.int64()), pa.array(own, pa.binary())],
                    [*ITEM, "bytes"],
                )

    return read.mapInArrow(run, "family long, n long, key binary, place long, bytes binary")


def cell_rows(items: DataFrame) -> DataFrame:
    """Each item's run cut at the grid of STEP offsets before its anchor: the cell's core and hull, its own place, and the item's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 1024):
                part = batch.slice(at, 1024)
                data, base, place = _laid_out(part)
                before, after = place >> 8 & 255, place & 255
                low, high = after // STEP, before // STEP
                of = np.repeat(np.arange(len(part)), high - low + 1)
                if not len(of):
                    continue
                cell = np.arange(len(of)) - np.repeat(np.cumsum(high - low + 1) - (high - low + 1), high - low + 1) + low[of]
                far, near = np.minimum((cell + 1) * STEP - 1, before[of]), np.maximum(cell * STEP, after[of])
                anchor = base[of] + before[of]  # the anchor's place in `data`
                names = Names(data)
                core = mix(names.of(anchor - cell * STEP, LENGTH - STEP + 1 + 0 * cell), cell.astype(np.uint64))
                hulls = hulls_of(data, names, anchor - far, far - near + LENGTH, far << 8 | near)
                own = pa.array(of)
                yield pa.RecordBatch.from_arrays(
                    [part["family"].take(own), pa.array(as_int64(core)), *hulls, part["n"].take(own), part["key"].take(own), part["place"].take(own), pa.array(_place(place[of] >> 16, far, near))],
                    ["family", "core", *HULL, "n", "key", "place", "cell"],
                )

    return items.mapInArrow(run, "family long, core long, hull long, hull2 long, n long, key binary, place long, cell long")


def _laid_out(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(the items' bytes one after another, where each begins, their places)."""
    own = part["bytes"].to_pylist()
    sizes = np.array([len(x) for x in own], np.int64)
    return np.frombuffer(b"".join(own), np.uint8), np.cumsum(sizes) - sizes, part["place"].to_numpy()


def string_rows(cells: DataFrame) -> DataFrame:
    """The single strings of each cell (with its item's bytes): the names of their LENGTH bytes and their start."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 1024):
                part = batch.slice(at, 1024)
                data, base, place = _laid_out(part)
                cell = part["cell"].to_numpy()
                far, near, before = cell >> 8 & 255, cell & 255, place >> 8 & 255
                n = far - near + 1
                of = np.repeat(np.arange(len(part)), n)
                if not len(of):
                    continue
                offset = far[of] - (np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n))
                named = hulls_of(data, Names(data), base[of] + before[of] - offset, LENGTH + 0 * offset, offset)
                own = pa.array(of)
                yield pa.RecordBatch.from_arrays(
                    [part["family"].take(own), *named, part["n"].take(own), part["key"].take(own), pa.array((place[of] >> 16) - offset)],
                    ["family", "name", "name2", "n", "key", "start"],
                )

    return cells.mapInArrow(run, "family long, name long, name2 long, n long, key binary, start long")


def _keyed(documents: DataFrame) -> DataFrame:
    """(doc_id, text, key); rows equal in id and text have one key."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    key = F.unhex(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("\n"), text).cast("binary")))
    return documents.select(F.col("doc_id").cast("long"), text.alias("text"), key.alias("key"))


def repeated_spans(documents: DataFrame) -> DataFrame:
    """`spans_found`, all of which runs here, with texts in small batches."""
    with small_batches(documents.sparkSession):
        return spans_found(documents)


def spans_found(documents: DataFrame) -> DataFrame:
    """(key, spans) of the documents with repeats: `spans` is an array of disjoint (start, end) in bytes,
    in order, that covers exactly the bytes in a string of LENGTH bytes that also starts elsewhere, in the same document or
    another. `key` is MD5 of id and text. Null text counts as empty. Rows equal in id and text have one row here; each is
    the other's elsewhere. An empty table gives no rows; a text of any length is named in parts of PART bytes;
    other columns are ignored."""
    keep = _Stored(documents.sparkSession)
    keyed = _keyed(documents).select("key", "text")
    grams = keep(_numbered(anchor_rows(keyed, False).groupBy("gram").agg(F.count("*").alias("n")).filter("n > 1"), ["gram"]), "grams")
    anchors = spread_join(anchor_rows(keyed, True), grams.drop("n"), ["gram"], hot_keys(grams, ["gram"]))
    anchors = keep(anchors.select(F.col("number").alias("family"), *HULL, "key", "place"), "anchors")
    repeated, items = _hulls(anchors, ["family"], F.lit(1), keep)
    items = keep(item_bytes(keyed, items), "items")
    start, end = place_span(F.col("place"))
    same = ["family", *HULL]
    found = spread_join(anchors, repeated.drop("n"), same, hot_keys(repeated, same)).select("key", start.alias("start"), end.alias("end"))

    cells = keep(cell_rows(items), "cells")
    repeated, open_cells = _hulls(cells, ["family", "core"], F.col("n"), keep)
    start, end = place_span(F.col("cell"))
    same = ["family", "core", *HULL]
    settled = spread_join(cells.filter("n = 1"), repeated.drop("n"), same, hot_keys(repeated, same))
    found = found.unionByName(settled.select("key", start.alias("start"), end.alias("end")))

    open_cells = open_cells.join(items.select("key", "place", "bytes"), ["key", "place"])
    strings = keep(string_rows(open_cells.select("family", "n", "key", "place", "cell", "bytes")), "strings")
    same = ["family", "name", "name2"]
    repeated = keep(strings.groupBy(*same).agg(F.sum("n").alias("m"), F.count("*").alias("n")).filter("m > 1").select(*same, "n"), "names")
    last = spread_join(strings.filter("n = 1").drop("n"), repeated.drop("n"), same, hot_keys(repeated, same))
    found = found.unionByName(last.select("key", "start", (F.col("start") + LENGTH).alias("end")))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            for at in range(0, len(batch), 1024):
                part = batch.slice(at, 1024)
                merged = [merge_spans(x) for x in part["spans"].to_pylist()]
                yield pa.RecordBatch.from_arrays([part["key"], pa.array(merged, kind)], ["key", "spans"])

    spans = found.groupBy("key").agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    spans = cut(spans.mapInArrow(merge, "key binary, spans array<struct<start:bigint,end:bigint>>"))
    keep.drop()
    return spans


def merge_spans(spans: list[dict]) -> list[dict]:
    """Disjoint runs; runs that touch are one."""
    out: list[dict] = []
    for x in sorted(spans, key=lambda x: (x["start"], x["end"])):
        if out and x["start"] <= out[-1]["end"]:
            out[-1]["end"] = max(out[-1]["end"], x["end"])
        else:
            out.append(dict(x))
    return out


def remove_repeats(documents: DataFrame, spans: DataFrame) -> DataFrame:
    """(key, spans, kept binary) of the documents with `spans` that keep some bytes: what is left, one after another."""
    spans = cut(spans.select("key", "spans"))
    read = document_filter(_keyed(documents).select("key", "text"), spans).join(spans, "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                kept = []
                for text, spans in zip(part["text"].to_pylist(), part["spans"].to_pylist(), strict=True):
                    raw, upto, left = text.encode(), 0, []
                    for x in spans:
                        left.append(raw[upto : x["start"]])
                        upto = x["end"]
                    kept.append(b"".join(left) + raw[upto:])
                yield pa.RecordBatch.from_arrays([part["key"], part["spans"], pa.array(kept, pa.binary())], ["key", "spans", "kept"])

    return read.select("key", "text", "spans").mapInArrow(run, "key binary, spans array<struct<start:bigint,end:bigint>>, kept binary")


EMPTY_SHA256 = hashlib.sha256(b"").hexdigest()


def repeat_digests(documents: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of each row of `documents`.

    Texts that lose nothing or all are digested where they are read; only the others are moved to meet their spans.
    Null texts count as empty and lose nothing; repeated rows are each the other's elsewhere and all returned; rows without an id
    are rows. An empty table gives none. Columns other than doc_id and text are ignored, whatever their names.
    """
    size = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    spans = repeated_spans(documents).select("key", "spans", size.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"))
    raw = F.col("text").cast("binary")
    with small_batches(documents.sparkSession):
        base = cut(_keyed(documents).select("doc_id", "key", F.length(raw).cast("long").alias("n_bytes"), F.sha2(raw, 256).alias("whole")))
    hot = hot_keys(base.groupBy("key").agg(F.count("*").alias("n")), ["key"])
    sizes = base.select("key", "n_bytes").distinct()
    partly = spans.join(sizes, "key").filter("n_removed < n_bytes").select("key", "spans")
    with small_batches(documents.sparkSession):
        kept = cut(remove_repeats(documents, partly).select("key", F.sha2("kept", 256).alias("kept")))
    told = spans.join(kept, "key", "left").select("key", "n_removed", "n_spans", F.coalesce("kept", F.lit(EMPTY_SHA256)).alias("kept"))
    return spread_join(base, told, ["key"], hot, "left").select(
        "doc_id", "n_bytes", F.coalesce("n_removed", F.lit(0)).alias("n_removed"), F.coalesce("n_spans", F.lit(0)).alias("n_spans"), F.coalesce("kept", "whole").alias("kept_sha256")
    )
