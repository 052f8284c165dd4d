"""Merging of segments against a plain fold from left to right."""

import random

from scriptorium.operators import recognise
from scriptorium.sources.readers import variant_edges

VARIANTS = {"A": ["AB", "AC"], "M": ["MB"], "C": []}
NON_KEYS = {"AB", "AC", "MB"}
KINDS = ["right", "left_1", "left_2", "both_1", "both_2"]


def fold(segments, two_back):
    """Segments: (idx, word, {kind: (char, conf) or None}); the units read, one after the other."""
    used, out = [False] * len(segments), []
    for p, (idx, word, scores) in enumerate(segments):
        if used[p] or not scores["base"]:
            continue
        base, conf = scores["base"]
        locked, left = conf >= 95, []
        for back in range(1, (3 if base in two_back else 2) if not locked else 1):
            if p - back < 0 or used[p - back] or segments[p - back][1] != word:
                break
            left.append(p - back)
        right = p + 1 < len(segments) and segments[p + 1][1] == word
        own = set(VARIANTS.get(base, []))
        bag = [("base", base, conf, [p], 3)]
        for name, place, able, ahead in (("both", 0, left and right, True), ("right", 1, right, True), ("left", 2, left, False)):
            got = scores.get(name if name == "right" else f"{name}_{len(left)}") if able else None
            if not got or (got[0] not in own if locked and ahead else got[0] not in own | NON_KEYS):
                continue
            bag.append((name, *got, ([left[-1]] if name != "right" else []) + [p] + ([p + 1] if ahead else []), place))
        kind, char, conf, taken, _ = min(bag, key=lambda c: (-(c[2] + (2 if c[0] in ("right", "both") and c[1] in own else 0)), c[4]))
        for t in taken:
            used[t] = True
        out.append((idx, segments[min(taken)][0], char, conf, kind, len(taken)))
    return out


def image(rng, n, gaps):
    word, out = 0, []
    for k in range(n):
        word += rng.random() < 0.15
        scores = {"base": None if rng.random() < gaps else (rng.choice(["A", "M", "C", "AB"]), rng.choice([40.0, 60.0, 80.0, 95.0, 99.0]))}
        for kind in KINDS:
            scores[kind] = rng.choice([None, (rng.choice(["AB", "AC", "MB", "C"]), rng.choice([40.0, 58.0, 60.0, 78.0, 97.0, 99.0]))])
        out.append((3 * k + 1, word, scores))
    return out


def rows_of(images):
    return [(i, idx, word, *[v for kind in ["base", *KINDS] for v in (scores[kind] or (None, None))]) for i, segs in images.items() for idx, word, scores in segs]


def check(spark, images, long, two_back=("M", "C")):
    shape = "img int, seg_idx int, word_index int, " + ", ".join(f"{k} string, {k}_conf double" for k in ["base", *KINDS])
    scored = spark.createDataFrame(rows_of(images), shape).repartition(5)
    found = recognise.merged_segments(scored, variant_edges(spark, VARIANTS), "img", two_back, long).collect()
    got = {i: [] for i in images}
    for r in sorted(found, key=lambda r: (r.img, r.idx)):
        got[r.img].append((r.idx, r.first_idx, r.char, r.conf, r.kind, r.n_segs))
    assert got == {i: fold(segs, two_back) for i, segs in images.items()}


def test_many_images(spark):
    rng = random.Random(1)
    images = {i: image(rng, rng.randint(1, 14), rng.choice([0.0, 0.2, 0.5, 0.8])) for i in range(400)}
    kinds = {unit[4] for segs in images.values() for unit in fold(segs, ("M", "C"))}
    assert kinds == {"base", "right", "left", "both"}
    check(spark, images, [])


def test_long_images_by_blocks(spark):
    rng = random.Random(2)
    images = {i: image(rng, 600, gaps) for i, gaps in enumerate([0.0, 0.1, 0.4, 0.7])}
    check(spark, images, [0, 1, 2, 3])


def test_words_unknown_or_alone(spark):
    rng = random.Random(3)
    images = {0: [(k, None, s) for k, _, s in image(rng, 9, 0.3)], 1: image(rng, 1, 0.0), 2: image(rng, 1, 1.0)}
    found = [x for i in images for x in fold([(k, k if w is None else w, s) for k, w, s in images[i]], ())]
    shape = "img int, seg_idx int, word_index int, " + ", ".join(f"{k} string, {k}_conf double" for k in ["base", *KINDS])
    scored = spark.createDataFrame(rows_of(images), shape)
    assert recognise.merged_segments(scored, variant_edges(spark, VARIANTS), "img").count() == len(found)
    assert recognise.merged_segments(scored.limit(0), variant_edges(spark, VARIANTS), "img").isEmpty()
    assert recognise.merged_segments(scored, variant_edges(spark, {}), "img").filter("kind <> 'base'").isEmpty()
