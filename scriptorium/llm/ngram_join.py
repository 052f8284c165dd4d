"""Near duplicates by an n-gram Jaccard join: MinHash banding, then verification on whole n-gram sets.

Documents with one n-gram set are one node. A node's MinHash signature is cut into bands, and nodes that share
a band's hash are candidates; the numbers of bands and rows are chosen for a target recall at the threshold. Nodes that
hang together by bands form a component. Its pairs are verified on whole n-gram sets in one of two groupings, whichever moves
fewer n-grams: all its nodes together, where most of them are near each other, or each band's nodes by themselves, where
chance matches chain texts that are not. Groups are cut into blocks of bounded size, and only counts of links and spanning
edges come out. Verified edges, again as components, give the classes.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.common import as_int64, cut, free_name, hot_keys, mix, spread_join, text_key
from scriptorium.llm.graph import connected_components

#: Words whose hashes a task keeps.
KEPT_WORDS = 500_000
#: Hashes of a signature at most.
MOST_HASHES = 128
#: Pairs of an n-gram's holders up to which they are counted one by one; more are counted by matrix products.
FEW_PAIRS = 64
#: N-grams of a block on average, at most; a longer text is a block of its own size.
BLOCK_GRAMS = 1_000_000
ROWS = 512


def choose_bands(threshold: float, recall: float) -> tuple[int, int]:
    """(bands, rows) with as many rows as fit in MOST_HASHES, so that a pair at the threshold is found with probability `recall`."""
    found = (1, 1)
    for rows in range(1, MOST_HASHES + 1):
        chance = threshold**rows
        bands = 1 if chance >= 1 else math.ceil(math.log(1 - recall) / math.log(1 - chance))
        if bands * rows > MOST_HASHES:
            break
        found = bands, rows
    return found


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= KEPT_WORDS:
            self.clear()
        self[word] = out = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
        return out


class Shingler:
    """Sets of word n-grams as sorted 64-bit hashes. Words are lower-cased and split at white space; a text
    with fewer than n words has one n-gram of all its words, and a text without words none."""

    def __init__(self, n: int = 5):
        self.n, self.hashes = n, _Hashes()

    def sets(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        for text in texts:
            words = (text or "").lower().split()
            x = np.fromiter(map(self.hashes.__getitem__, words), np.uint64, len(words))
            n = min(self.n, len(x))
            if not n:
                yield x
                continue
            grams = x[: len(x) - n + 1]
            for k in range(1, n):
                grams = mix(grams, x[k : len(x) - n + 1 + k])
            yield np.unique(grams)


class Signer:
    """Band hashes of n-gram sets."""

    def __init__(self, bands: int, rows: int, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.bands, self.rows = bands, rows
        self.flip = rng.integers(0, 2**32, bands * rows, dtype=np.uint32)[:, None]
        self.times = (rng.integers(0, 2**32, bands * rows, dtype=np.uint32) | np.uint32(1))[:, None]
        self.index = np.arange(bands, dtype=np.uint64)

    def bands_of(self, grams: np.ndarray) -> np.ndarray:
        short = (grams >> np.uint64(32)).astype(np.uint32)
        least = np.full(len(self.flip), 0xFFFFFFFF, np.uint32)
        for at in range(0, len(short), 8192):
            hashed = (short[None, at : at + 8192] ^ self.flip) * self.times
            hashed ^= hashed >> np.uint32(15)
            hashed *= np.uint32(0x85EBCA6B)
            least = np.minimum(least, hashed.min(1))
        out = self.index
        for column in least.reshape(self.bands, self.rows).T:
            out = mix(out, column.astype(np.uint64))
        return out


def _node(grams: np.ndarray) -> bytes:
    return hashlib.blake2b(grams.tobytes(), digest_size=16).digest()


def signatures(documents: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    """(doc_id, text_key, node, n_grams, bands) of each row; `bands` is empty where there are no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, signer = Shingler(n), Signer(bands, rows)
        for batch in batches:
            for at in range(0, len(batch), ROWS):
                part = batch.slice(at, ROWS)
                nodes, sizes, found = [], [], []
                for grams in shingler.sets(part["text"].to_pylist()):
                    nodes.append(_node(grams))
                    sizes.append(len(grams))
                    found.append(as_int64(signer.bands_of(grams)) if len(grams) else [])
                yield pa.RecordBatch.from_arrays(
                    [
                        part["doc_id"], part["text_key"], pa.array(nodes, pa.binary()), pa.array(sizes, pa.int64()),
                        pa.array(found, pa.list_(pa.int64())),
                    ],
                    ["doc_id", "text_key", "node", "n_grams", "bands"],
                )

    keyed = documents.select(F.col("doc_id").cast("long"), text_key(F.col("text")).alias("text_key"), "text")
    return keyed.mapInArrow(run, "doc_id long, text_key binary, node binary, n_grams long, bands array<long>")


def gram_sets(texts: DataFrame, n: int) -> DataFrame:
    """(key columns..., grams binary) of (key columns..., text)."""
    keys = [c for c in texts.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(n)
        for batch in batches:
            for at in range(0, len(batch), ROWS):
                part = batch.slice(at, ROWS)
                grams = [x.tobytes() for x in shingler.sets(part["text"].to_pylist())]
                yield pa.RecordBatch.from_arrays([*(part[k] for k in keys), pa.array(grams, pa.binary())], [*keys, "grams"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.schema if f.name != "text")
    return texts.mapInArrow(run, f"{kinds}, grams binary")


def shared_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """|a & b| for each a of `left` and b of `right`, sets as sorted arrays."""
    out = np.zeros((len(left), len(right)), np.int64)
    sides = []
    for sets in (left, right):
        grams = np.concatenate(sets)
        order = np.argsort(grams, kind="stable")
        sides.append((grams[order], np.repeat(np.arange(len(sets)), [len(x) for x in sets])[order]))
    common = np.intersect1d(np.unique(sides[0][0]), np.unique(sides[1][0]), assume_unique=True)
    (gl, ol), (gr, orr) = sides
    a, b = np.searchsorted(gl, common), np.searchsorted(gr, common)
    na, nb = np.searchsorted(gl, common, "right") - a, np.searchsorted(gr, common, "right") - b
    pairs = na * nb
    few = np.flatnonzero(pairs <= FEW_PAIRS)
    for at in range(0, len(few), 20_000):
        own = few[at : at + 20_000]
        n = pairs[own]
        of = np.repeat(np.arange(len(own)), n)
        within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        i = ol[a[own][of] + within // nb[own][of]]
        j = orr[b[own][of] + within % nb[own][of]]
        out += np.bincount(i * len(right) + j, minlength=out.size).reshape(out.shape)
    many = np.flatnonzero(pairs > FEW_PAIRS)
    for at in range(0, len(many), 2048):
        own = many[at : at + 2048]
        matrices = []
        for start, n, owner, size in ((a, na, ol, len(left)), (b, nb, orr, len(right))):
            dense = np.zeros((size, len(own)), np.float32)
            of = np.repeat(np.arange(len(own)), n[own])
            within = np.arange(len(of)) - np.repeat(np.cumsum(n[own]) - n[own], n[own])
            dense[owner[start[own][of] + within], of] = 1
            matrices.append(dense)
        out += np.rint(matrices[0] @ matrices[1].T).astype(np.int64)
    return out


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least member of each one's component, for the edges a-b among 0..n-1."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        while (new[new] != new).any():
            new = new[new]
        if (new == root).all():
            return root
        root = new


NO_LINKS = pd.DataFrame({"node": [], "n_links": np.zeros(0, np.int64), "root": []})


def verify_block(threshold: float, rows: pd.DataFrame, band: int | None = None) -> pd.DataFrame:
    """Links of one group of nodes, those of side 0 with each other (a block with itself) or side 0 with side 1: (node, n_links, root),
    one row for each node with a link. A link counts the documents of the other node. With `band`, the hash of the band that the
    nodes share, a pair counts only if that is the first of its common bands, so once in all."""
    rows = rows.sort_values(["side", "node"])
    sets = [np.frombuffer(x, np.uint64) for x in rows["grams"]]
    docs, nodes = rows["n_docs"].to_numpy(np.int64), rows["node"].to_numpy()
    first = int((rows["side"] == 0).sum())
    alone = first == len(rows)
    left, right = (0, len(rows)) if alone else (first, len(rows) - first)
    if alone:
        ours, theirs, shift = sets, sets, 0
    else:
        ours, theirs, shift = sets[:left], sets[left:], left
    sizes = np.array([len(x) for x in sets])
    both = shared_counts(ours, theirs) if ours and theirs else np.zeros((len(ours), len(theirs)), np.int64)
    total = sizes[: len(ours), None] + sizes[None, shift : shift + right] - both
    linked = both >= threshold * total - 1e-9
    if alone:
        np.fill_diagonal(linked, False)
    if band is not None:
        i, j = np.nonzero(linked)
        bands = np.stack(rows["bands"].to_numpy()).astype(np.int64)
        for at in range(0, len(i), 65536):
            a, b = bands[i[at : at + 65536]], bands[j[at : at + 65536] + shift]
            first = (a == b).argmax(1)[:, None]
            linked[i[at : at + 65536], j[at : at + 65536]] = np.take_along_axis(a, first, 1)[:, 0] == band
    links = np.zeros(len(rows), np.int64)
    links[: len(ours)] += linked @ docs[shift : shift + right]
    if not alone:
        links[shift:] += linked.T @ docs[:left]
    i, j = np.nonzero(linked)
    root = _roots(len(rows), i, j + shift)
    some = np.zeros(len(rows), bool)
    some[i] = some[j + shift] = True
    return pd.DataFrame({"node": nodes[some], "n_links": links[some], "root": nodes[root[some]]})


def groups_to_verify(nodes: DataFrame, block: int) -> DataFrame:
    """(component, band, n_blocks, node, n_docs, text_key, bands): the groups of nodes whose pairs are to be verified, so that all pairs with a
    common band meet in one of them at least. A group is a component of band matches (`band` and `bands` null) or the nodes of
    one band. Of the two a component takes the one that sends fewer n-grams, counting a set once for each block of its group."""

    def blocks(n: str, grams: str) -> F.Column:
        return F.greatest(F.ceil(F.col(n) / block), F.ceil(F.col(grams) / BLOCK_GRAMS)).cast("int")

    banded = nodes.select("node", "n_grams", F.explode(F.array_distinct("bands")).alias("band"))
    met = banded.groupBy("band").agg(F.count("*").alias("n"), F.sum("n_grams").alias("grams"), F.min("node").alias("b")).filter("n > 1")
    met = cut(met.select("band", "b", "grams", blocks("n", "grams").alias("n_blocks")))
    candidates = connected_components(banded.join(met.select("band", "b"), "band").select(F.col("node").alias("a"), "b"))
    candidates = cut(candidates.join(nodes.select("node", "n_grams"), "node"))
    whole = candidates.groupBy("component").agg(F.count("*").alias("n"), F.sum("n_grams").alias("grams"))
    whole = whole.select("component", "grams", blocks("n", "grams").alias("n_blocks"))
    each = met.join(candidates.select(F.col("node").alias("b"), "component"), "b")
    each = each.groupBy("component").agg(F.sum(F.col("grams") * F.col("n_blocks")).alias("sent"))
    chosen = whole.join(each, "component").select("component", "n_blocks", (F.col("sent") < F.col("grams") * F.col("n_blocks")).alias("apart"))
    chosen = cut(candidates.select("node", "component").join(chosen, "component").join(nodes, "node"))
    own = ["component", "node", "n_docs", "text_key"]
    together = chosen.filter("NOT apart").select(
        F.lit(None).cast("long").alias("band"), "n_blocks", *own, F.lit(None).cast("array<long>").alias("bands")
    )
    apart = chosen.filter("apart").select(*own, "bands", F.explode(F.array_distinct("bands")).alias("band")).join(met.select("band", "n_blocks"), "band")
    return together.unionByName(apart)


def near_duplicates(documents: DataFrame, n: int = 5, threshold: float = 0.8, recall: float = 0.999, block: int = 512) -> DataFrame:
    """(doc_id, text_key, class_key, class_id, n_links) of each row: the class's key and its least doc_id, and the number of
    other rows whose word n-gram set has a Jaccard similarity of at least `threshold` with its own.

    Classes are the connected components of these links. Rows with equal n-gram sets are linked to each other;
    rows without words count as equal to each other. Null text counts as empty; a class without ids has a null class_id.
    Repeated rows are rows. Whole texts are compared, however long, and words are lower-cased; only doc_id and text are read, whatever
    other columns there are. An empty table gives an empty one. `recall` is for a pair just at the
    threshold; where nodes that share no band meet in a group they are verified too, so more is found. Groups of any size are
    verified in blocks of `block` nodes and BLOCK_GRAMS n-grams on average, each pair of blocks by itself (see `groups_to_verify`).
    """
    bands, rows = choose_bands(threshold, recall)
    signed = cut(signatures(documents, n, bands, rows))
    nodes = cut(
        signed.groupBy("node").agg(
            F.count("*").alias("n_docs"), F.min("doc_id").alias("least"), F.min("text_key").alias("text_key"),
            F.first("n_grams").alias("n_grams"), F.first("bands").alias("bands"),
        )
    )
    placed = cut(groups_to_verify(nodes.drop("least"), block))
    placed = placed.withColumn("own", F.pmod(F.xxhash64("node"), F.col("n_blocks")).cast("int"))
    keyed = documents.select(text_key(F.col("text")).alias("text_key"), "text")
    wanted = placed.select("text_key").distinct()
    # copies of one text or node may be a large share of all rows
    hot_texts = hot_keys(signed.groupBy("text_key").agg(F.count("*").alias("n")), ["text_key"])
    # what is wanted grows with the corpus, so one plan for all sizes
    texts = spread_join(keyed, wanted, ["text_key"], hot_texts, "left_semi", "merge").dropDuplicates(["text_key"])
    sets = placed.join(gram_sets(texts, n), "text_key")
    # each block meets itself once, and every other block of its group once
    meetings = sets.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1))).select(
        "component",
        F.least("own", "other").alias("low"),
        F.greatest("own", "other").alias("high"),
        (F.col("own") > F.col("other")).cast("int").alias("side"),
        "band",
        "node",
        "n_docs",
        "bands",
        "grams",
    )

    def verify(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        lonely = key[1] != key[2] and group["side"].nunique() < 2  # the other block is empty
        return NO_LINKS if lonely else verify_block(threshold, group, None if pd.isna(key[3]) else int(key[3]))

    found = cut(meetings.groupBy("component", "low", "high", "band").applyInPandas(verify, "node binary, n_links long, root binary"))
    links = found.groupBy("node").agg(F.sum("n_links").alias("n_links"))
    classes = connected_components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    named = classes.join(nodes.select("node", "least"), "node")
    named = named.join(named.groupBy("component").agg(F.min("least").alias("class_id")), "component").select(
        "node", F.col("component").alias("class_key"), "class_id"
    )
    told = nodes.select("node", "n_docs", "least").join(named, "node", "left").join(links, "node", "left").select(
        "node",
        F.coalesce("class_key", "node").alias("class_key"),
        F.when(F.col("class_key").isNull(), F.col("least")).otherwise(F.col("class_id")).alias("class_id"),
        (F.coalesce("n_links", F.lit(0)) + F.col("n_docs") - 1).alias("n_links"),
    )
    hot_nodes = hot_keys(nodes.select("node", F.col("n_docs").alias("n")), ["node"])
    every = spread_join(signed.select("doc_id", "text_key", "node"), told, ["node"], hot_nodes)
    return every.select("doc_id", "text_key", "class_key", "class_id", "n_links")


def keep_one(documents: DataFrame, **options) -> DataFrame:
    """`documents` with one row of each class left: that with the least doc_id (null only where all are), and of several with
    that id the least text key. All columns stay as they are; of equal rows one stays."""
    found = cut(near_duplicates(documents, **options))
    own = found.groupBy("class_key").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_key")).alias("k"))
    own_id, own_key, key = (free_name(x, documents) for x in ("id", "text_key", "key"))
    keys = own.select(F.col("k.doc_id").alias(own_id), F.col("k.text_key").alias(own_key))
    repeated = found.groupBy("doc_id", "text_key").agg(F.count("*").alias("n")).filter("n > 1")
    repeated = cut(repeated.select(F.col("doc_id").alias(own_id), F.col("text_key").alias(own_key)))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(own_id)) & (F.col(key) == F.col(own_key))
    kept = documents.withColumn(key, text_key(F.col("text"))).join(keys, same, "left_semi")
    if not repeated.isEmpty():
        several = kept.join(repeated, same, "left_semi").dropDuplicates(["doc_id", key])
        kept = kept.join(repeated, same, "left_anti").unionByName(several)
    return kept.drop(key)
