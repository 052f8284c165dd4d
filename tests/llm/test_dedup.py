import hashlib
import random
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from helpers import assert_same
from pyspark.sql import functions as F

from scriptorium.llm import graph, line_dedup, ngram_join, queries, suffix_dedup


def grams(text, n=5):
    w = (text or "").lower().split()
    return {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()


def classes_model(texts, threshold=0.8):
    sets = [grams(t) for t in texts]
    links = [[j for j in range(len(texts)) if j != i and (sets[i] == sets[j] or len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j]) > 0)] for i in range(len(texts))]
    root = list(range(len(texts)))
    for _ in texts:
        for i, js in enumerate(links):
            for j in js:
                root[i] = root[j] = min(root[i], root[j])
    return [(root[i], len(links[i])) for i in range(len(texts))]


def near_texts(seed=3):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    out = ["", None, " \n", "one two", "one two", "ONE  two", "a b c d e"]
    for _ in range(12):
        base = [rng.choice(words) for _ in range(120)]
        out.append(" ".join(base))
        for edits in (1, 2, 9):
            own = list(base)
            for _ in range(edits):
                own[rng.randrange(len(own))] = rng.choice(words)
            out.append(" ".join(own))
        out.append(" ".join(base).upper())
        out.append(" ".join(base[:60]))
    hub = [rng.choice(words) for _ in range(150)]
    for k in range(90):  # a group larger than a block
        own = list(hub)
        own[k] = "edit"
        out.append(" ".join(own))
    return out


def test_near_duplicates(spark):
    texts = near_texts()
    frame = spark.createDataFrame([(k, t, "x", b"y") for k, t in enumerate(texts)], "doc_id long, text string, node string, text_key binary")
    rows = sorted(ngram_join.near_duplicates(frame, block=16).collect(), key=lambda r: r.doc_id)
    assert [(r.class_id, r.n_links) for r in rows] == classes_model(texts)
    kept = ngram_join.keep_one(frame, block=16)
    assert kept.columns == frame.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for c, _ in classes_model(texts)})


def test_near_duplicates_edges(spark):
    schema = "doc_id long, text string"
    same = spark.createDataFrame([(1, "a b c d e f")] * 3 + [(None, "a b c d e f"), (None, "q r s t u v"), (None, "other words that are here now"), (1, "z z z")], schema)
    rows = ngram_join.near_duplicates(same).collect()
    assert sorted((r.class_id or 0, r.n_links) for r in rows) == [(0, 0), (0, 0), (1, 0), (1, 3), (1, 3), (1, 3), (1, 3)]
    kept = sorted((r.doc_id or 0, r.text) for r in ngram_join.keep_one(same).collect())
    assert kept == [(0, "other words that are here now"), (0, "q r s t u v"), (1, "a b c d e f"), (1, "z z z")]
    empty = same.limit(0)
    assert ngram_join.near_duplicates(empty).count() == 0 and ngram_join.keep_one(empty).count() == 0
    long = spark.createDataFrame([(1, "word " * 300_000), (2, "word " * 300_000 + "end")], schema)
    assert [r.n_links for r in ngram_join.near_duplicates(long).collect()] == [0, 0]


def test_near_duplicates_of_chained_texts(spark):
    """Each text shares most of its words with the next, few enough to be no link but for some; by bands all hang together."""
    n, at, texts = 1200, 0, []
    for k in range(n):
        texts.append(" ".join(f"w{j}" for j in range(at, at + 100)))
        at += 6 if k % 50 == 0 else 12
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bands, rows = ngram_join.choose_bands(0.8, 0.999)
    nodes = ngram_join.signatures(frame, 5, bands, rows).withColumn("n_docs", F.lit(1)).drop("doc_id")
    groups = ngram_join.groups_to_verify(nodes, 16).collect()
    apart = [r for r in groups if r.band is not None]
    assert len({r.node for r in apart}) > n / 2, "long chains are verified by bands"
    assert max(Counter(r.node for r in groups).values()) <= bands and all(r.n_blocks == 1 for r in apart)
    sets = [grams(t) for t in texts]
    want = [sum(len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) for j in range(max(0, i - 9), min(n, i + 10)) if j != i) for i in range(n)]
    assert 0 < sum(want) < n / 4
    found = sorted(ngram_join.near_duplicates(frame, block=16).collect(), key=lambda r: r.doc_id)
    assert [r.n_links for r in found] == want
    assert all((r.class_id == i - 1) == (i > 0 and (i - 1) % 50 == 0) for i, r in enumerate(found))


def test_verify_block_counts_a_pair_in_its_first_common_band():
    sets = [np.arange(10, dtype=np.uint64).tobytes()] * 2
    rows = pd.DataFrame({"side": 0, "node": [b"a", b"b"], "n_docs": 1, "grams": sets, "bands": [np.array([1, 5, 7]), np.array([2, 5, 7])]})
    assert len(ngram_join.verify_block(0.8, rows, 5)) == 2 and len(ngram_join.verify_block(0.8, rows, 7)) == 0
    assert len(ngram_join.verify_block(0.8, rows)) == 2


def test_shared_counts():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 60, n)).astype(np.uint64) for n in rng.integers(1, 50, 40)]
    got = ngram_join.shared_counts(sets[:25], sets[25:])
    assert (got == [[len(np.intersect1d(a, b)) for b in sets[25:]] for a in sets[:25]]).all()


def test_bands():
    bands, rows = ngram_join.choose_bands(0.8, 0.999)
    assert 1 - (1 - 0.8**rows) ** bands >= 0.999 and bands * rows <= ngram_join.MOST_HASHES


def test_components(spark):
    rng = random.Random(0)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(180)] + [(k, k + 1) for k in range(1000, 1100)] + [(5, 5), (None, 3)]
    root = {}

    def find(a):
        root.setdefault(a, a)
        while root[a] != a:
            a = root[a]
        return a

    for a, b in edges:
        if a is not None and a != b:
            p, q = find(a), find(b)
            root[max(p, q)] = min(p, q)
    found = graph.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.node: r.component for r in found} == {a: find(a) for a in root} and len(found) == len(root)
    assert graph.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_ngram_query(spark, sf_dir):
    assert_same(queries.op3_ngram_join(spark, sf_dir), queries.ORACLES["op3_ngram_join"], sf_dir)


def sentences_model(text):
    """[start, end, words] of each sentence, by a scan of single characters."""
    out, start, at = [], 0, 0
    while at <= len(text):
        last = at == len(text) or text[at] == "\n"
        stop = at
        if not last and text[at] in ".!?。！？":
            while stop < len(text) and text[stop] in (".!?" if text[at] in ".!?" else "。！？"):
                stop += 1
            blank = stop
            while blank < len(text) and text[blank].isspace() and text[blank] != "\n":
                blank += 1
            if blank > stop or text[at] in "。！？":
                out.append((start, blank, text[start:blank].lower().split()))
                start = at = blank
                continue
            at = stop
            continue
        if last:
            out.append((start, at, text[start:at].lower().split()))
            start = at + 1
        at += 1
    return [x for x in out if x[2]]


def size_model(words):
    return sum(1 + sum("\u3040" <= c <= "\u30ff" or "\u4e00" <= c <= "\u9fff" for c in w) for w in words)


def lines_model(rows, least=line_dedup.MIN_WORDS, line_least=line_dedup.LINE_WORDS):
    """Texts and spans by comparing word lists: no hashes, and runs found by trying all."""
    seen, out = set(), []
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, hashlib.md5((r[1] or "").encode()).digest())):
        own, gone = [], [False] * len(text or "")
        pieces = sentences_model(text or "")
        sizes = [size_model(p[2]) for p in pieces]
        for i in range(len(pieces)):
            line_end = max(j for j in range(i, len(pieces)) if "\n" not in text[pieces[i][0] : pieces[j][1]])
            begins_line = i == 0 or "\n" in text[pieces[i - 1][0] : pieces[i][0]]
            for j in range(i, len(pieces)):
                total = sum(sizes[i : j + 1])
                shortest = total >= least and (total - sizes[j] < least or total - sizes[i] < least)
                if shortest or (total >= line_least and begins_line and j == line_end) or (j - i + 1 == len(pieces) and total < least):
                    own.append((pieces[i][0], pieces[j][1], tuple(w for p in pieces[i : j + 1] for w in p[2])))
                elif total - sizes[i] - sizes[j] > least and j > line_end:
                    break
        for a, b, unit in sorted(own, key=lambda x: x[:2]):
            if unit in seen:
                gone[a:b] = [True] * (b - a)
            seen.add(unit)
        was = list(gone)
        for k in range(len(gone) + 1):  # the line break of lines that go whole: that after them, at the end of the text that before
            if k and was[k - 1] and (k == len(gone) or not was[k]):
                begin = k
                while begin and was[begin - 1]:
                    begin -= 1
                whole = begin == 0 or text[begin - 1] == "\n"
                if whole and k < len(gone) and text[k] == "\n":
                    gone[k] = True
                elif whole and k == len(gone) and begin:
                    gone[begin - 1] = True
        spans = [k for k in range(len(gone) + 1) if (k < len(gone) and gone[k]) != (k > 0 and gone[k - 1])]
        out.append((doc_id, None if text is None else "".join(c for c, g in zip(text, gone) if not g), list(zip(spans[::2], spans[1::2]))))
    return out


def test_units():
    text = "One two three four.  Five six!\n\n a B c\nlast"
    assert sorted(line_dedup.units(text, 3)) == [(0, 21, "one two three four."), (0, 30, "one two three four. five six!"), (21, 38, "five six! a b c"), (32, 38, "a b c"), (32, 43, "a b c last")]
    for a, b, unit in line_dedup.units(text, 1):
        assert " ".join(text[a:b].lower().split()) == unit
    assert line_dedup.units("too short", 3) == [(0, 9, "too short")] and line_dedup.units(" \n", 1) == []


def test_cut_spans():
    text = "aa\nbb\ncc"
    assert line_dedup.cut_spans(text, [(0, 2)]) == ("bb\ncc", [(0, 3)])
    assert line_dedup.cut_spans(text, [(6, 8)]) == ("aa\nbb", [(5, 8)])
    assert line_dedup.cut_spans(text, [(0, 2), (3, 5), (6, 8)])[0] == ""
    assert line_dedup.cut_spans(text, [(1, 2)]) == ("a\nbb\ncc", [(1, 2)])


def test_dedup_units(spark):
    rng = random.Random(6)
    lines = [" ".join(rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(rng.randint(1, 14))) + rng.choice([".", "", "! And one more sentence of six words."]) for _ in range(60)]
    rows = [(k, "\n".join(rng.choice(lines) for _ in range(rng.randint(0, 12)))) for k in range(80)] + [(80, None), (81, ""), (82, "long line " * 50_000)]
    frame = spark.createDataFrame([(k, t, "c") for k, t in rows], "doc_id long, text string, removed_spans string")
    found = line_dedup.dedup_units(frame)
    assert found.columns == ["doc_id", "text", "removed_spans"]
    got = sorted(((r.doc_id, r.text, [(s.start, s.end) for s in r.removed_spans]) for r in found.collect()), key=lambda x: x[0])
    assert got == lines_model(rows)
    dotted = line_dedup.dedup_units(frame.withColumnRenamed("removed_spans", "a.b").withColumn("__spans", F.lit(7)), spans_col="a.c")
    assert dotted.columns == ["doc_id", "text", "a.b", "__spans", "a.c"] and dotted.filter("`a.b` = 'c' AND __spans = 7").count() == len(rows)
    # a passage of many lines that repeats stays in its first document alone
    passage = "\n".join(f"line {k} of a passage with several words in it" for k in range(8))
    own = spark.createDataFrame([(k, f"head {k}\n{passage}\ntail {k}") for k in (3, 1, 2)], "doc_id long, text string")
    texts = {r.doc_id: r.text for r in line_dedup.dedup_units(own).collect()}
    assert passage in texts[1] and texts[2] == "head 2\ntail 2" and texts[3] == "head 3\ntail 3"
    assert line_dedup.dedup_units(own.limit(0)).count() == 0
    twice = spark.createDataFrame([(None, passage), (None, passage), (5, passage)], "doc_id long, text string")
    assert sorted(r.text for r in line_dedup.dedup_units(twice).collect()) == ["", passage, passage]


def without_repeats(spark, *texts):
    rows = line_dedup.dedup_units(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    return [r.text for r in sorted(rows, key=lambda r: r.doc_id)]


def test_dedup_of_short_lines_and_sentences(spark):
    menu = [f"dish {k}, {k} euro" for k in range(15)]  # 60 words in lines of four
    verse = [f"Word {k} rhymes. So {k}." for k in range(15)]
    mixed = [s for k in range(9) for s in (f"Short {k}.", f"A sentence {k} with more than six words in it.")]
    around = lambda k, passage: f"own {k}\n{passage}\nother {k}"
    for passage in ("\n".join(menu), "\n".join(verse), " ".join(verse), "\n".join(mixed)):
        kept = without_repeats(spark, around(1, passage), around(2, passage), around(3, passage))
        assert kept == [around(1, passage), "own 2\nother 2", "own 3\nother 3"]


def test_dedup_of_lines_and_of_short_texts(spark):
    line = " ".join(f"w{k}" for k in range(14))
    assert without_repeats(spark, f"one a\n{line}\ntwo b", f"three c\n{line}", f"{line}\nfour d") == [f"one a\n{line}\ntwo b", "three c", "four d"]
    assert without_repeats(spark, "ten words or so", "Ten words  or so", "others") == ["ten words or so", "", "others"]


def test_many_equal_rows(spark):
    """Rows of one id and text are one document, however many; they lose the same, and their key is dealt over tasks."""
    line = " ".join(f"w{k}" for k in range(20))
    rows = [(1, f"{line}\nfirst")] + [(2, f"own\n{line}")] * 600 + [(None, "x y z")] * 300 + [(k, f"text {k} alone") for k in range(3, 200)]
    got = line_dedup.dedup_units(spark.createDataFrame(rows, "doc_id long, text string")).groupBy("doc_id", "text").count().collect()
    assert {(r.doc_id, r.text, r["count"]) for r in got if r.doc_id is None or r.doc_id < 3} == {(1, f"{line}\nfirst", 1), (2, "own", 600), (None, "x y z", 300)}
    assert len(got) == 200


def test_dedup_of_paragraphs(spark):
    paragraph = "to the sea we sail\nof the night we sing\nand so go we all"  # fifteen words in three lines
    assert without_repeats(spark, f"a b\n\n{paragraph}\n\nc", f"d\n\n{paragraph}\n \ne") == [f"a b\n\n{paragraph}\n\nc", "d\n\n \ne"]


def test_dedup_without_spaces(spark):
    line, other = "今日は天気がとても良いので散歩に行きました。", "明日は雨が降るかもしれません。"
    assert without_repeats(spark, line + other, f"{other}\n短い\n短い") == [line + other, "短い\n短い"]


def test_line_dedup_query(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    want = {d: (len(t or ""), sum(b - a for a, b in s), len(s), t2 or "") for (d, t2, s), t in ((m, dict(rows)[m[0]]) for m in lines_model(rows))}
    got = {r.doc_id: (r.n_chars, r.n_removed, r.n_spans, r.text or "") for r in queries.op4_line_dedup(spark, sf_dir).collect()}
    assert got == want


def repeats_model(rows, size=200):
    raw = [(t or "").encode() for _, t in rows]
    starts = Counter(t[k : k + size] for t in raw for k in range(len(t) - size + 1))
    out = []
    for (doc_id, _), t in zip(rows, raw):
        gone = [False] * len(t)
        for k in range(len(t) - size + 1):
            if starts[t[k : k + size]] > 1:
                gone[k : k + size] = [True] * size
        kept = bytes(b for b, g in zip(t, gone) if not g)
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((doc_id, len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def repeat_texts(seed=9):
    rng = random.Random(seed)
    some = lambda n, letters="abcdefgh éß": "".join(rng.choice(letters) for _ in range(n))
    base = [some(rng.randint(150, 900)) for _ in range(8)]
    texts = ["", None, "short", "x" * 199, "x" * 200, "y" * 201, "z" * 1000, "ab" * 300, some(100), base[0], base[0], base[0][:199], base[0][:200]]
    for _ in range(40):
        a, b = rng.choice(base), rng.choice(base)
        i, j = rng.randrange(len(a)), rng.randrange(len(b))
        texts.append(some(rng.randint(0, 60)) + a[i : i + rng.randint(100, 500)] + some(rng.randint(0, 5)) + b[j : j + rng.randint(180, 260)])
    for k in range(30):  # one edit each: boundaries all along the text
        own = list(base[1] + base[2])
        own[(k * 37) % len(own)] = "#"
        texts.append("".join(own))
    return texts


def digests(frame):
    return sorted((tuple(r) for r in suffix_dedup.repeat_digests(frame).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()), key=repr)


def test_repeats(spark, monkeypatch):
    rows = list(enumerate(repeat_texts()))
    frame = spark.createDataFrame([(k, t, 1) for k, t in rows], "doc_id long, text string, n_bytes int")
    assert digests(frame) == sorted(repeats_model(rows), key=repr)


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, "q" * 250), (1, "q" * 250)], [(None, "".join(map(str, range(200))) + "0123" * 60)], [(7, "".join(map(str, range(400)))), (7, "tail" + "".join(map(str, range(400))))]])
def test_repeats_edges(spark, rows):
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert digests(frame) == sorted(repeats_model(rows), key=repr)


def test_repeats_tell_equal_ids_apart(spark):
    """Rows without an id, or with one id: each text by itself."""
    rng = random.Random(4)
    texts = ["".join(rng.choice("abc ") for _ in range(220)) for _ in range(300)]
    rows = [(rng.choice([None, 5]), t) for t in texts] + [(None, texts[0]), (5, texts[0]), (5, texts[1])] * 2
    assert digests(spark.createDataFrame(rows, "doc_id long, text string")) == sorted(repeats_model(rows), key=repr)


def test_repeats_query(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert sorted((tuple(r) for r in queries.op6_suffix_dedup(spark, sf_dir).collect()), key=repr) == sorted(repeats_model(rows), key=repr)


def test_parts_of_long_texts():
    rng = random.Random(1)
    text = rng.randbytes(2_500)
    old, suffix_dedup.PART = suffix_dedup.PART, 700
    try:
        found = Counter()
        for data, ends, held in suffix_dedup.parts([b"", text, text[:150], text[:900]]):
            names = suffix_dedup.Names(data)
            at, first, last = suffix_dedup.find_anchors(names, ends)
            for a, b in zip(first, last):
                k, shift, where = max((h for h in held if h[1] <= a), key=lambda h: h[1])
                for p in range(a, b + 1):
                    found[k, p - shift + where] += 1
        assert found == Counter({(k, p): 1 for k, n in ((1, 2500), (3, 900)) for p in range(n - 199)})
    finally:
        suffix_dedup.PART = old


def test_op6_texts_in_small_batches(spark, tmp_path):
    """3,000 rows of one partition reach Python 1,000 at a time at most, wherever op6 reads them, and the session's own setting is as before."""
    name, seen = "spark.sql.execution.arrow.maxRecordsPerBatch", str(tmp_path)

    def noted(batches):
        for batch in batches:
            with open(f"{seen}/{random.SystemRandom().getrandbits(64)}-{batch.num_rows}", "w"):
                yield batch

    passage = "".join(f"{k} words " for k in range(40))
    rows = [(k, f"own text {k} " * 3 + (passage if k % 1000 < 2 else "")) for k in range(3000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).mapInArrow(noted, "doc_id long, text string")
    for given in (None, "2000", "300"):
        spark.conf.unset(name) if given is None else spark.conf.set(name, given)
        try:
            found = suffix_dedup.repeat_digests(frame)
            assert spark.conf.get(name, None) == given
            assert sorted(tuple(r) for r in found.collect()) == sorted(repeats_model(rows))
        finally:
            spark.conf.unset(name)
        sizes = [int(p.name.split("-")[1]) for p in tmp_path.iterdir()]
        assert sizes and max(sizes) <= 1000
