import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from scriptorium.functions import text as T
from scriptorium.plans import queries as plans


def one(spark, column, **values):
    names = list(values)
    frame = spark.createDataFrame([tuple(values.values())], ", ".join(f"{n} string" for n in names))
    return frame.select(column.alias("v")).first().v


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(new[j] + 1, row[j + 1] + 1, row[j] + (x != y)))
        row = new
    return row[-1]


@pytest.mark.parametrize(
    "pred, ref, want", [("kitten", "sitting", 42.86), ("ab", "", 0.0), ("", "ab", 100.0), ("ab", None, 0.0), (None, "ab", 100.0), ("කා", "ක", 100.0)]
)
def test_cer(spark, pred, ref, want):
    assert one(spark, T.cer(F.col("p"), F.col("r")), p=pred, r=ref) == want


@pytest.mark.parametrize("make", [T.wer, T.wer_long])
@pytest.mark.parametrize("pred, ref, want", [("a b c", "a x c d", 50.0), ("", "a b", 100.0), ("a", " ", 0.0), ("a b c", "a", 200.0), (None, None, 0.0)])
def test_wer(spark, make, pred, ref, want):
    assert one(spark, make(F.col("p"), F.col("r")), p=pred, r=ref) == want


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=9), st.lists(st.sampled_from("abc"), max_size=9))
def test_word_edits(a, b):
    import pandas as pd

    assert T._word_edits(pd.Series([" ".join(a)]), pd.Series([" ".join(b)])).tolist() == [edits(a, b)]


@pytest.mark.parametrize(
    "word, want", [("abca", ["ab", "c", "a"]), ("axb", None), ("", []), ("abab", ["ab", "ab"]), ("ba", ["b", "a"]), ("a.b", None)]
)
def test_longest_match(spark, word, want):
    assert one(spark, T.longest_match(F.col("w"), ["ab", "a", "b", "c"]), w=word) == want


def test_longest_match_quotes_units(spark):
    assert one(spark, T.longest_match(F.col("w"), [".", "\\E", "a"]), w="a.\\E") == ["a", ".", "\\E"]


@pytest.mark.parametrize("line, want", [('x, "he said ""hi""" ', ("x", 'he said ""hi')), ("no comma", (None, None)), ("k,", ("k", "")), (" k , a, b", ("k", "a, b"))])
def test_label_line(spark, line, want):
    key, text = T.parse_label_line(F.col("l"))
    assert tuple(one(spark, F.struct(key.alias("k"), text.alias("t")), l=line)) == want


@pytest.mark.parametrize("shown, want", [("ක", "l"), ("කා", "ld"), ("කේ", "fla"), ("කෙක", None), ("", None), ("x", None), ("කෛ", "ffl"), ("කෲ", "lDD"), ("ආ", "wd")])
def test_legacy(spark, shown, want):
    assert one(spark, T.legacy_encode(F.col("s")), s=shown) == want


@pytest.mark.parametrize(
    "make, value, want",
    [
        (T.class_char, "combo_ක_0058", "ක"),
        (T.class_char, "ab_c", "ab_c"),
        (T.stem_of, "/a/b.c/x.y.png", "x.y"),
        (T.stem_of, "/a/none", "none"),
        (T.first_stem, "a.b.png", "a"),
    ],
)
def test_names(spark, make, value, want):
    assert one(spark, make(F.col("s")), s=value) == want


def test_three_tokens(spark):
    parts = T.three_tokens(F.col("s"))
    assert tuple(one(spark, F.struct(*parts), s="0058_Basic_My_Font")) == ("0058", "Basic", "My_Font")
    assert tuple(one(spark, F.struct(*parts), s="x")) == ("x", "", "")


def test_snap_takes_the_first_of_ties(spark):
    row = spark.range(1).select(T.snap(F.lit(98.0), [95.0, 97.0, 99.0]).alias("a"), T.snap(F.lit(50.0), [95.0, 97.0]).alias("b")).first()
    assert (row.a, row.b) == (97.0, 95.0)


def test_edit_distance_of_long_sequences():
    rng = random.Random(4)
    for n, m, letters in ((0, 0, "a"), (0, 70, "ab"), (150, 90, "abc"), (65, 200, "abcdefgh"), (130, 130, "ab")):
        a, b = ([rng.choice(letters) for _ in range(k)] for k in (n, m))
        assert T.edit_distance(a, b) == T.edit_distance(b, a) == edits(a, b)


def test_wer_of_whole_texts(spark, tmp_path):
    rng = random.Random(5)
    some = lambda n: " ".join(rng.choice(["ab", "é\u00a0è", "c\u3000d", "straße", "x"]) for _ in range(n))
    texts = [some(40), "a b " + some(90), None, some(13), "", f"{some(12)}\n\t{some(30)}", "ÉÈ", some(60) + " end", "x"]
    rows = [(k * 700, t, ("en", "fr", "de")[k % 3]) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    words = [[w for w in re.split("[ \t\n]+", t or "") if w] for t in texts]
    want = {k * 700: round(edits(p, r) / len(r) * 100, 2) if r else 0.0 for k, (p, r) in enumerate(zip(words, words[1:]))}
    got = {r.doc_id: r.wer for r in plans.q02b_wer_whole(spark, str(tmp_path)).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 0.011 for k in want)
