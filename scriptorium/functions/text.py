"""Column functions on text: error rates, tokens, segmentation, names and encodings. All stay in the JVM but `wer_long`."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Codepoint -> legacy-font code. One-letter codes, then longer ones, then vowel signs with what goes before and after.
LEGACY_SINGLE = {
    0x0D9A: "l", 0x0D9B: "L", 0x0D9C: ".", 0x0D9D: ">", 0x0D9E: "X", 0x0DA0: "p", 0x0DA1: "P", 0x0DA2: "c", 0x0DA4: "[", 0x0DA5: "{",
    0x0DA7: "g", 0x0DA8: "G", 0x0DA9: "v", 0x0DAA: "V", 0x0DAB: "K", 0x0DAC: "~", 0x0DAD: ";", 0x0DAE: ":", 0x0DAF: "o", 0x0DB0: "O",
    0x0DB1: "k", 0x0DB3: "|", 0x0DB4: "m", 0x0DB5: "M", 0x0DB6: "n", 0x0DB7: "N", 0x0DB8: "u", 0x0DB9: "U", 0x0DBA: "h", 0x0DBB: "r",
    0x0DBD: ",", 0x0DC0: "j", 0x0DC1: "Y", 0x0DC2: "I", 0x0DC3: "i", 0x0DC4: "y", 0x0DC5: "<", 0x0DC6: "*", 0x0D85: "w", 0x0D89: "b",
    0x0D8A: "B", 0x0D8B: "W", 0x0D8D: "R", 0x0D91: "t", 0x0D94: "T", 0x0DCA: "a", 0x0DCF: "d", 0x0DD0: "e", 0x0DD1: "E", 0x0DD2: "s",
    0x0DD3: "S", 0x0DD4: "q", 0x0DD6: "Q", 0x0DD8: "D", 0x0D82: "x",
}
LEGACY_MULTI = {
    0x0D86: "wd", 0x0D87: "we", 0x0D88: "wE", 0x0D92: "ta", 0x0D93: "ft", 0x0D95: "Ta", 0x0D96: "T!", 0x0D8C: "W!", 0x0D8E: "RD",
    0x0DF2: "DD", 0x0D9F: "`.", 0x0DA3: "CO", 0x0DA6: "`P",
}
LEGACY_AROUND = {0x0DD9: ("f", ""), 0x0DDA: ("f", "a"), 0x0DDC: ("f", "d"), 0x0DDD: ("f", "da"), 0x0DDE: ("f", "!"), 0x0DDB: ("ff", "")}
# Class-folder prefixes of glyph categories; others keep their own name.
FOLDER_PREFIX = {"independent_vowel": "vowel", "combination": "combo"}


def percent(part: Column, whole: Column) -> Column:
    """Share in percent with two decimals, half-even."""
    return F.bround(part / whole * 100, 2)


def cer(predicted: Column, reference: Column) -> Column:
    """Character error rate in percent: edits over the reference's codepoints. 0 for an empty or null reference; may exceed 100."""
    predicted, reference = F.coalesce(predicted, F.lit("")), F.coalesce(reference, F.lit(""))
    return F.when(reference == "", F.lit(0.0)).otherwise(percent(F.levenshtein(predicted, reference), F.length(reference)))


def tokens(text: Column) -> Column:
    """Words between white space; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != "")


#: As many single characters as `sequence_edits` can tell words apart: the unified ideographs, a block without gaps.
SYMBOLS = "".join(map(chr, range(0x4E00, 0x9FA6)))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with `value` computed once however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def sequence_edits(a: Column, b: Column) -> Column:
    """Edit distance of two arrays of strings: each distinct string becomes one character, and these texts are compared. For
    arrays with up to len(SYMBOLS) distinct strings, and best for some hundreds (see `wer_long`)."""

    def spelt(words: Column, known: Column) -> Column:
        return F.array_join(F.transform(words, lambda w: F.substring(F.lit(SYMBOLS), F.array_position(known, w).cast("int"), F.lit(1))), "")

    def edits(known: Column) -> Column:
        over = F.raise_error(F.lit(f"more than {len(SYMBOLS)} distinct words: use wer_long")).cast("int")
        return F.when(F.size(known) > len(SYMBOLS), over).otherwise(F.levenshtein(spelt(a, known), spelt(b, known)))

    return bound(F.array_distinct(F.concat(a, b)), edits)


def wer(predicted: Column, reference: Column) -> Column:
    """Word error rate in percent, as `cer` over words; for texts of up to some hundreds of words (see `wer_long`)."""
    p, r = tokens(predicted), tokens(reference)
    return bound(F.struct(p.alias("p"), r.alias("r")), lambda x: F.when(F.size(x["r"]) == 0, F.lit(0.0)).otherwise(percent(sequence_edits(x["p"], x["r"]), F.size(x["r"]))))


def edit_distance(a: list, b: list) -> int:
    """Edits between two sequences, exact for any length. A row of the table is two whole numbers, one bit per item of the longer
    sequence (Myers, in Hyyrö's form), so that a step of the shorter one costs a few operations on as many bits."""
    same = next((k for k, (x, y) in enumerate(zip(reversed(a), reversed(b), strict=False)) if x != y), min(len(a), len(b)))
    a, b = a[: len(a) - same], b[: len(b) - same]
    a, b = (a, b) if len(a) < len(b) else (b, a)
    at: dict = {}
    for k, x in enumerate(b):
        at.setdefault(x, []).append(k)
    masks = {x: sum(1 << k for k in at[x]) for x in set(a) if x in at}
    every, last, found = (1 << len(b)) - 1, len(b) - 1, len(b)
    up, down = every, 0
    for x in a:
        same = masks.get(x, 0)
        across = (((same & up) + up) ^ up) | same
        more, less = down | (every & ~(across | up)), up & across
        found += (more >> last & 1) - (less >> last & 1)
        more, less, own = more << 1 | 1, less << 1, same | down
        up, down = (less | ~(own | more)) & every, more & own & every
    return found


#: As `tokens` splits: Java's white space, which has no non-ASCII characters.
ASCII_SPACE = re.compile(r"[ \t\n\x0b\f\r]+")


def _word_edits(predicted: pd.Series, reference: pd.Series) -> pd.Series:
    words = lambda t: [w for w in ASCII_SPACE.split(t or "") if w]
    return pd.Series([edit_distance(words(p), words(r)) for p, r in zip(predicted, reference, strict=True)], dtype="int32")


def wer_long(predicted: Column, reference: Column) -> Column:
    """`wer` for texts of any length: the table's rows are bits of whole numbers, in Arrow batches."""
    n = F.size(tokens(reference))
    edits = F.pandas_udf(_word_edits, "int")(predicted, reference)
    return F.when(n == 0, F.lit(0.0)).otherwise(percent(edits, n))


def longest_match(word: Column, units: list[str]) -> Column:
    """`word` as an array of `units`, always the longest that fits, without going back; null if some place has none, empty for
    an empty word. The matcher tries the longer units first and skips what none fits, so the parts add up to the word only if all of it is covered."""
    ordered = sorted({u for u in units if u}, key=lambda u: (-len(u), u))
    pattern = "|".join("\\Q" + u.replace("\\E", "\\E\\\\E\\Q") + "\\E" for u in ordered) or "(?!)"
    found = F.regexp_extract_all(word, F.lit(pattern), F.lit(0))
    return F.when(F.array_join(found, "") == word, found)


def stem_of(path: Column) -> Column:
    """The file name without its last suffix."""
    return F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")


def first_stem(name: Column) -> Column:
    """What stands before the first dot."""
    return F.substring_index(name, ".", 1)


def class_char(name: Column) -> Column:
    """The character in `prefix_char_id`: the second of three or more tokens, else the whole name."""
    parts = F.split(name, "_")
    return F.when(F.size(parts) >= 3, F.try_element_at(parts, F.lit(2))).otherwise(name)


def class_folder(category: Column, char: Column, class_id: Column) -> Column:
    names = F.create_map(*[F.lit(x) for pair in FOLDER_PREFIX.items() for x in pair])
    return F.concat_ws("_", F.coalesce(F.try_element_at(names, category), category), char, class_id)


def three_tokens(stem: Column) -> tuple[Column, Column, Column]:
    """class_id, tier and font stem of `{class_id}_{tier}_{font_stem}`; missing ones are empty."""
    parts = F.split(stem, "_", 3)
    return tuple(F.coalesce(F.try_element_at(parts, F.lit(k)), F.lit("")) for k in (1, 2, 3))


def legacy_encode(rendered: Column) -> Column:
    """The legacy-font string of one or two codepoints; null for anything else."""
    single, multi, before, after = (
        F.create_map(*[F.lit(x) for k, v in entries for x in (chr(k), v)])
        for entries in (
            LEGACY_SINGLE.items(),
            LEGACY_MULTI.items(),
            [(k, v[0]) for k, v in LEGACY_AROUND.items()],
            [(k, v[1]) for k, v in LEGACY_AROUND.items()],
        )
    )
    first, sign = F.substring(rendered, 1, 1), F.substring(rendered, 2, 1)
    base = F.coalesce(F.try_element_at(single, first), F.try_element_at(multi, first))
    own = F.when(sign == chr(0x0DF2), F.lit(LEGACY_MULTI[0x0DF2])).otherwise(F.try_element_at(single, sign))
    around = F.concat(F.try_element_at(before, sign), base, F.try_element_at(after, sign))
    return F.when(F.length(rendered) == 1, base).when(F.length(rendered) == 2, F.coalesce(around, F.concat(base, own)))


def parse_label_line(line: Column) -> tuple[Column, Column]:
    """Key and text of a label line: split at the first comma, trimmed, outer double quotes stripped, nothing unescaped.
    Both are null for a line without a comma."""
    at = F.instr(line, ",")
    key = F.when(at > 0, F.trim(F.substring_index(line, ",", 1)))
    text = F.when(at > 0, F.trim(F.regexp_replace(line, r"^[^,]*,", "")))
    return key, F.regexp_replace(text, r'^"+|"+$', "")


def snap(value: Column, grid: list[float]) -> Column:
    """The grid's nearest value, the first of equally near ones."""
    options = F.array(*[F.struct(F.abs(value - F.lit(g)).alias("d"), F.lit(k).alias("k"), F.lit(float(g)).alias("g")) for k, g in enumerate(grid)])
    return F.array_min(options)["g"]


def band(value: Column, limits: list[tuple[float, str]], rest: str) -> Column:
    """The name of the first limit that `value` is below."""
    out = F.when(value < limits[0][0], limits[0][1])
    for limit, name in limits[1:]:
        out = out.when(value < limit, name)
    return out.otherwise(rest)


def correlation_verdict(r: Column) -> Column:
    return F.when(r > 0.3, "DIRECT").when(r < -0.3, "INVERSE").otherwise("WEAK")


def padded_id(kind: str, number: Column, width: int) -> Column:
    """Ids such as probe_000012."""
    return F.format_string(f"{kind}_%0{width}d", number.cast("long"))


def codepoints(text: Column) -> Column:
    """The codepoint of each character; none for an empty text."""
    return F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c))  # of a character: its codepoint
