"""Byte-level BPE by merge replay over an inverted index from token pair to word positions.

A slice of the corpus is split into words; its distinct words lie side by side as one array
of tokens. The index maps each mergeable pair, by rank, to the positions where it stands. Ranks are
replayed from the lowest: all of a rank's positions merge at once, and only the pairs with the touched left
and right neighbours change their place in the index. Words don't interact, so each task replays the words
that it meets and nothing is shuffled; a word's merges are kept for the rest of the task.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: No pair.
NEVER = np.int64(1 << 40)
#: Words that a task keeps; more are forgotten and replayed when they come again.
KEPT_WORDS = 200_000
#: Characters of text whose words are numbered, and whose new words are replayed, at once (a longer text alone).
TAKEN = 8_000_000
#: Characters of text whose tokens are laid out at once.
LAID_OUT = 2_000_000


def gather(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The runs values[starts[i]:starts[i]+sizes[i]] of all i in `at`, one after another."""
    n = sizes[at]
    ends = np.cumsum(n, dtype=np.int64)
    if not len(ends):
        return values[:0]
    return values[np.repeat(starts[at] - (ends - n), n) + np.arange(ends[-1])]


class Vocabulary:
    """Ranks of byte strings: token bytes by id, and the merged token of each pair of tokens."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        size = max(ranks.values(), default=-1) + 1
        by_id = [b""] * size
        for token, rank in ranks.items():
            by_id[rank] = token
        self.bytes = np.frombuffer(b"".join(by_id), np.uint8)
        self.sizes = np.array([len(x) for x in by_id], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.single = np.array([ranks[bytes([n])] for n in range(256)], np.int64)
        found = {}
        for token, rank in ranks.items():
            for k in range(1, len(token)):
                left, right = ranks.get(token[:k]), ranks.get(token[k:])
                if left is not None and right is not None:
                    found[left << 32 | right] = rank
        self.pairs = found
        self.keys = np.array(sorted(found), np.int64)
        self.merged = np.array([found[k] for k in self.keys.tolist()], np.int64)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(left), NEVER)
        keys = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.merged[at], NEVER)

    def decode(self, ids: np.ndarray) -> bytes:
        return gather(self.bytes, self.starts, self.sizes, ids).tobytes()


@lru_cache(maxsize=2)
def load_vocabulary(path: str) -> Vocabulary:
    """The vocabulary of a rank file: lines of base64 bytes and rank."""
    with open(path, "rb") as lines:
        return Vocabulary({base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)})


def _alone(vocabulary: Vocabulary, word: bytes) -> list[int]:
    """One word's merges, the lowest rank first and the leftmost of these, with a heap."""
    tokens = [int(vocabulary.single[b]) for b in word]
    after, before = [*range(1, len(word)), -1], list(range(-1, len(word) - 1))
    pairs = vocabulary.pairs
    heap = [(r, k) for k in range(len(word) - 1) if (r := pairs.get(tokens[k] << 32 | tokens[k + 1])) is not None]
    heapq.heapify(heap)
    while heap:
        rank, k = heapq.heappop(heap)
        right = after[k]
        if tokens[k] < 0 or right < 0 or pairs.get(tokens[k] << 32 | tokens[right]) != rank:
            continue
        tokens[k], tokens[right], after[k] = rank, -1, after[right]
        if after[k] >= 0:
            before[after[k]] = k
        for a in (before[k], k):
            if a >= 0 and after[a] >= 0 and (r := pairs.get(tokens[a] << 32 | tokens[after[a]])) is not None:
                heapq.heappush(heap, (r, a))
    return [t for t in tokens if t >= 0]


def replay(vocabulary: Vocabulary, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all words one after another, ids per word), exactly as merging each word alone."""
    sizes = np.array([len(w) for w in words], np.int64)
    tokens = vocabulary.single[np.frombuffer(b"".join(words), np.uint8)]
    n = len(tokens)
    word_of = np.repeat(np.arange(len(words)), sizes)
    after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
    filled = sizes > 0
    last = np.cumsum(sizes)[filled] - 1
    after[last] = -1
    before[(np.cumsum(sizes) - sizes)[filled]] = -1
    rank_at = np.full(n, NEVER)
    inner = np.flatnonzero(after >= 0)
    rank_at[inner] = vocabulary.pair_ranks(tokens[inner], tokens[inner + 1])
    index: dict[int, list[np.ndarray]] = {}
    heap: list[int] = []

    def add(places: np.ndarray, ranks: np.ndarray) -> None:
        some = ranks < NEVER
        if not some.any():
            return
        places, ranks = places[some], ranks[some]
        order = np.argsort(ranks, kind="stable")
        places, ranks = places[order], ranks[order]
        bounds = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
        firsts = [0, *bounds.tolist(), len(ranks)]
        for a, b in zip(firsts, firsts[1:]):
            rank = int(ranks[a])
            if rank not in index:
                index[rank] = []
                heapq.heappush(heap, rank)
            index[rank].append(places[a:b])

    add(inner, rank_at[inner])
    odd = np.zeros(len(words), bool)
    while heap:
        rank = heapq.heappop(heap)
        places = np.concatenate(index.pop(rank))
        places = np.unique(places[rank_at[places] == rank])
        if not len(places):
            continue
        right = after[places]
        if len(places) > 1 and (chained := right[:-1] == places[1:]).any():
            # in a run of overlapping pairs the first, third, ... merge
            start = np.flatnonzero(np.concatenate([[True], ~chained]))
            nth = np.arange(len(places)) - np.repeat(start, np.diff([*start.tolist(), len(places)]))
            places, right = places[nth % 2 == 0], right[nth % 2 == 0]
        beyond = after[right]
        # the leftmost merges first, and its pair with a neighbour that is still unmerged may come before the next one
        near = places[beyond >= 0]
        early = vocabulary.pair_ranks(np.full(len(near), rank), tokens[beyond[beyond >= 0]]) <= rank
        odd[word_of[near[early]]] = True
        tokens[places] = rank
        tokens[right] = -1
        rank_at[right] = NEVER
        after[places] = beyond
        before[beyond[beyond >= 0]] = places[beyond >= 0]
        rank_at[places] = NEVER
        left = before[places]
        touched = np.concatenate([left[left >= 0], places[beyond >= 0]])
        ranks = vocabulary.pair_ranks(tokens[touched], tokens[after[touched]])
        rank_at[touched] = ranks
        if (ranks <= rank).any():
            odd[word_of[touched[ranks <= rank]]] = True  # such a word's order of merges is its own
        add(touched, ranks)
    kept = tokens >= 0
    counts = np.bincount(word_of[kept], minlength=len(words)).astype(np.int64)
    ids = tokens[kept]
    if odd.any():
        parts = np.split(ids, np.cumsum(counts)[:-1])
        for k in np.flatnonzero(odd).tolist():
            parts[k] = np.array(_alone(vocabulary, words[k]), np.int64)
        ids, counts = np.concatenate(parts), np.array([len(x) for x in parts], np.int64)
    return ids, counts


class _Words(dict):
    """A number for each word, in the order of arrival."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


class Encoder:
    """Encodes texts word by word with the merges of one vocabulary; keeps up to KEPT_WORDS words."""

    def __init__(self, vocabulary: Vocabulary, pattern: str):
        self.vocabulary, self.split = vocabulary, regex.compile(pattern).findall
        self.forget()

    def forget(self) -> None:
        self.words = _Words()
        self.ids = np.zeros(0, np.int32)
        self.sizes = self.starts = np.zeros(0, np.int64)

    def encode(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(ids, ids per text) of successive runs of texts."""
        if len(self.words) > KEPT_WORDS:
            self.forget()
        known = len(self.words)
        number, split = self.words.__getitem__, self.split
        numbers = [np.fromiter(map(number, split(t)), np.int32) for t in texts]
        if len(self.words) > known:
            fresh = [w.encode() for w in list(self.words)[known:]]
            ids, sizes = replay(self.vocabulary, fresh)
            self.ids = np.concatenate([self.ids, ids.astype(np.int32)])
            self.sizes = np.concatenate([self.sizes, sizes])
            self.starts = np.cumsum(self.sizes) - self.sizes
        at = 0
        while at < len(texts):
            end, laid = at, 0
            while end < len(texts) and (laid == 0 or laid + len(texts[end]) <= LAID_OUT):
                laid += len(texts[end]) + 1
                end += 1
            run = np.concatenate(numbers[at:end])
            ends = np.cumsum([len(x) for x in numbers[at:end]])
            upto = np.concatenate([[0], np.cumsum(self.sizes[run])])
            counts = np.diff(upto[np.concatenate([[0], ends])])
            yield gather(self.ids, self.starts, self.sizes, run), counts
            at = end


def taken(column: pa.Array) -> Iterator[list[str]]:
    """A column's texts, null as empty, in runs of up to TAKEN characters."""
    texts, size = [], 0
    for value in column:
        text = value.as_py() or ""
        if texts and size + len(text) > TAKEN:
            yield texts
            texts, size = [], 0
        texts.append(text)
        size += len(text)
    if texts:
        yield texts


@lru_cache(maxsize=1)
def _encoder(path: str, pattern: str) -> Encoder:
    return Encoder(load_vocabulary(path), pattern)


def encode_bpe(documents: DataFrame, vocabulary_path: str, pattern: str) -> DataFrame:
    """(doc_id, ids array<int>) of each row's whole text: each match of `pattern` is merged separately.

    Special tokens are not looked for. Null text counts as empty and has no ids. Repeated rows are all
    returned and other columns left out. `vocabulary_path` must be readable on the executors.
    """

    def run(batches):
        encoder = _encoder(vocabulary_path, pattern)
        for batch in batches:
            at = 0
            for texts in taken(batch["text"]):
                for ids, counts in encoder.encode(texts):
                    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                    lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids))
                    yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(at, len(counts)), lists], ["doc_id", "ids"])
                    at += len(counts)

    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, ids array<int>")


def decode_bpe(encoded: DataFrame, vocabulary_path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, decoded) of each (doc_id, ids): null ids count as none."""

    def run(batches):
        vocabulary = load_vocabulary(vocabulary_path)
        for batch in batches:
            lists = batch["ids"].fill_null(pa.scalar([], batch["ids"].type)) if batch["ids"].null_count else batch["ids"]
            values = lists.values.to_numpy(zero_copy_only=False)
            offsets = lists.offsets.to_numpy()
            for first in range(0, len(batch), 256):
                bounds = offsets[first : min(first + 256, len(batch)) + 1]
                own = [values[a:b] for a, b in zip(bounds, bounds[1:])]
                decoded = [vocabulary.decode(x) for x in own]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch["doc_id"].slice(first, len(own)),
                        pa.array([len(x) for x in own], pa.int64()),
                        pa.array([hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in own]),
                        pa.array([hashlib.sha256(x).hexdigest() for x in decoded]),
                        pa.array(decoded, pa.binary()),
                    ],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "decoded"],
                )

    return encoded.select("doc_id", "ids").mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, decoded binary"
    )
