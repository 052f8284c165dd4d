import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from scriptorium.llm import bpe, packing, queries

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
JSON = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = ["", None, "Hello  world's 123\n\n\t x", "éß 𝄞 日本語 \u00a0\u2003 a", "a" * 3000, "!" * 500, " " * 3000, "<|endoftext|> x", "The cat sat."]


@pytest.fixture(scope="module")
def reference():
    ranks = bpe.load_vocabulary(RANKS).ranks
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_replay(reference):
    rng = random.Random(3)
    words = [bytes(rng.choice(b"abcdehinotrs !0=\xc3\xa9") for _ in range(rng.randint(1, 40))) for _ in range(3000)] + [b"", b"a" * 20_000]
    ids, counts = bpe.replay(bpe.load_vocabulary(RANKS), words)
    assert len(counts) == len(words)
    for own, word in zip(np.split(ids, np.cumsum(counts)[:-1]), words):
        assert own.tolist() == (reference._encode_single_piece(word) if word else []) == bpe._alone(bpe.load_vocabulary(RANKS), word)


def test_replay_of_vocabularies_out_of_order():
    """Ranks that no training gives: a merge can open a pair of lower rank."""
    rng = random.Random(8)
    for _ in range(60):
        tokens = {bytes([b]) for b in range(256)}
        extra = {bytes(rng.choice(b"ab") for _ in range(rng.randint(2, 4))) for _ in range(8)}
        order = [*sorted(tokens), *rng.sample(sorted(extra), len(extra))]
        vocabulary = bpe.Vocabulary({t: k for k, t in enumerate(order)})
        words = [bytes(rng.choice(b"ab") for _ in range(rng.randint(1, 12))) for _ in range(40)]
        ids, counts = bpe.replay(vocabulary, words)
        for own, word in zip(np.split(ids, np.cumsum(counts)[:-1]), words):
            parts = [word[k : k + 1] for k in range(len(word))]
            while True:
                best = min(((vocabulary.ranks[a + b], k) for k, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in vocabulary.ranks), default=None)
                if best is None:
                    break
                parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
            assert own.tolist() == [vocabulary.ranks[p] for p in parts]


def test_bpe_operator(spark, reference):
    texts = [*TEXTS, "word " * 100_000]
    frame = spark.createDataFrame([(k, t, "c") for k, t in enumerate(texts)] + [(None, "x", "c")], "doc_id long, text string, ids string")
    encoded = bpe.encode_bpe(frame, RANKS, public_tokenizers.PATTERN)
    rows = {r.doc_id: r for r in bpe.decode_bpe(encoded, RANKS).collect()}
    assert len(rows) == len(texts) + 1
    for k, t in enumerate(texts):
        want = np.array(reference.encode_ordinary(t or ""), "<u4")
        assert (rows[k].n_tokens, rows[k].ids_sha256) == (len(want), hashlib.sha256(want.tobytes()).hexdigest())
        assert rows[k].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest() and bytes(rows[k].decoded) == (t or "").encode()
    assert bpe.decode_bpe(bpe.encode_bpe(frame.limit(0), RANKS, public_tokenizers.PATTERN), RANKS).count() == 0


def test_bpe_forgets_words(reference, monkeypatch):
    monkeypatch.setattr(bpe, "KEPT_WORDS", 3)
    monkeypatch.setattr(bpe, "LAID_OUT", 10)
    encoder = bpe.Encoder(bpe.load_vocabulary(RANKS), public_tokenizers.PATTERN)
    for texts in (["one two three four", "five"], ["six one two", ""], ["seven"]):
        got = [x.tolist() for ids, counts in encoder.encode(texts) for x in np.split(ids, np.cumsum(counts)[:-1])]
        assert got == [reference.encode_ordinary(t) for t in texts]


def test_tokenise_is_the_tokenizer_s(spark, sf_dir):
    named = Tokenizer.from_file(JSON)
    added = [t.content for t in named.get_added_tokens_decoder().values()]
    documents = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    for t in [x or "" for x in TEXTS + documents] + ["\n" * 300_000, "a b  c " * 2000] + [f"a{x}b {x}" for x in added]:
        assert packing.tokenise(t, JSON, RANKS, public_tokenizers.PATTERN) == named.encode(t, add_special_tokens=False).ids == packing.tokenise(t, JSON, None, None)
    assert named.encode(added[0], add_special_tokens=False).ids == packing.tokenise(added[0], JSON, RANKS, public_tokenizers.PATTERN) and len(packing.tokenise(added[0], JSON, None, None)) == 1


def test_bpe_query(spark, sf_dir, reference):
    rows = {r.doc_id: r for r in queries.op5_byte_bpe(spark, sf_dir).collect()}
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    assert len(rows) == len(documents)
    for r in documents:
        ids = np.array(reference.encode_ordinary(r.text or ""), "<u4")
        assert (rows[r.doc_id].n_tokens, rows[r.doc_id].ids_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest())
        assert rows[r.doc_id].decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()


@pytest.mark.parametrize("n, want", [(1, [(0, 1)]), (1024, [(0, 1024)]), (1025, [(0, 1), (1, 1025)]), (2048, [(0, 1024), (1024, 2048)])])
def test_piece_bounds(n, want):
    assert list(packing.piece_bounds(n, 1024)) == want


@pytest.mark.parametrize("seed", range(6))
def test_plan(seed):
    rng = random.Random(seed)
    size = rng.choice([10, 64, 1024])
    histogram = Counter(min(size, max(1, int(rng.gammavariate(2, size / 5)))) for _ in range(rng.choice([1, 30, 3000])))
    plan = packing.plan_packing(histogram, size)
    used = Counter()
    for lengths, n in plan:
        assert sum(lengths) <= size and n > 0
        for x in lengths:
            used[x] += n
    assert used == histogram
    total = sum(n for _, n in plan)
    least = -(-sum(k * n for k, n in histogram.items()) // size)
    assert total <= least * 1.25 + 2
    assert packing.plan_packing({}, size) == []


def test_fit_patterns():
    counts = np.zeros(10)
    counts[[3, 7, 4, 6, 5]] = 5, 5, 2, 2, 4
    patterns = packing.exact_patterns(counts.astype(int), 10)
    assert sorted(map(tuple, patterns.tolist())) == [(4, 3, 3), (5, 5, 0), (6, 4, 0), (7, 3, 0)]
    x = packing.fit_patterns(counts, patterns, 3000)
    fitted = np.zeros(10)
    for p, n in zip(patterns, x):
        for v in p:
            fitted[v] += n * (v > 0)
    assert np.abs(fitted - counts).max() < 0.05 and (x >= 0).all()


def check_packing(rows, texts, size=1024):
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in by_sequence.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= size
    least = -(-sum(r.length for r in rows) // size)
    assert len(by_sequence) <= least * 1.1 + 2
    want = Counter()
    for doc_id, text in texts:
        ids = np.array(packing.tokenise(text or "", JSON, RANKS, public_tokenizers.PATTERN) + [2], "<u4")
        for k, (a, b) in enumerate(packing.piece_bounds(len(ids), size)):
            want[doc_id, k, a, b - a, zlib.crc32(ids[a:b])] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want


def test_packing_operator(spark):
    texts = [*enumerate(TEXTS), (3, "again"), (3, "again"), (None, "none"), (50, "many words here " * 4000), *((100 + k, "equal length") for k in range(60))]
    frame = spark.createDataFrame([(k, t, 1) for k, t in texts], "doc_id long, text string, piece int")
    check_packing(queries.pack_documents(frame).collect(), texts)
    assert queries.pack_documents(frame.limit(0)).count() == 0
    with_ids = packing.token_pieces(frame, JSON, with_ids=True).filter("doc_id = 8").first()
    assert with_ids.ids == packing.tokenise(TEXTS[8], JSON, None, None) + [2]


def test_packing_query(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    check_packing(queries.op7_pattern_packing(spark, sf_dir).collect(), docs)
