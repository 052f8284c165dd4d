"""Recognition given scores: top classes, neighbour candidates, variant validation, merging and text assembly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.functions.text import bound
from scriptorium.operators.scan import KeyScan, Running

#: A base this sure only merges with its own variants, and a merge into these gets the bonus.
LOCKED, BONUS = 95.0, 2.0


def softmax(logits: Column) -> Column:
    raised = lambda top: F.transform(logits, lambda v: F.exp((v - top).cast("double")))
    shares = lambda r: bound(F.aggregate(r, F.lit(0.0), lambda a, x: a + x), lambda total: F.transform(r, lambda v: v / total))
    return bound(bound(F.array_max(logits), raised), shares)


def top_classes(logits: Column, k: int = 5) -> Column:
    """array<struct<conf, idx>> of the k likeliest classes, in percent with two decimals; the lower class number where equal before rounding."""
    paired = F.transform(softmax(logits), lambda p, i: F.struct((-p).alias("neg"), i.alias("idx")))
    return F.transform(F.slice(F.array_sort(paired), 1, k), lambda t: F.struct(F.bround(-t["neg"] * 100, 2).alias("conf"), t["idx"].alias("idx")))


def named_classes(found: DataFrame, classes: DataFrame) -> DataFrame:
    """`found` (idx, ...) with `class_name` of the class map (idx as text, class_name); numbers without a name fall out."""
    return found.withColumn("__idx", F.col("idx").cast("string")).join(classes.withColumnRenamed("idx", "__idx"), "__idx").drop("__idx")


def decision_label(kind: Column, conf: Column, non_key: Column) -> Column:
    """How a unit was chosen: by itself (`kind` is base) or with a neighbour, and its confidence."""
    alone = F.concat(F.lit("standalone"), F.when(non_key, "[non-key]").otherwise(""))
    return F.concat(F.when(kind == "base", alone).otherwise(F.concat(F.lit("variant-map:"), kind)), F.format_string(" (%.1f%%)", conf))


def variant_sets(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(base, variants array) by base, and (compound) of the compounds that are no base themselves. edges: (base, compound or null)."""
    by_base = edges.groupBy("base").agg(F.array_sort(F.collect_set("compound")).alias("variants"))
    compounds = edges.filter("compound IS NOT NULL").select("compound").distinct()
    return by_base, compounds.join(edges.select(F.col("base").alias("compound")), "compound", "left_anti")


def candidates(segments: DataFrame, key: str, word: str, order: str) -> DataFrame:
    """`segments` with the neighbours within their word: prev_1, prev_2 and next_1 (their `order`), null outside the word."""
    place = Window.partitionBy(key).orderBy(order)
    out = segments
    for name, column, n in (("prev_1", F.lag, 1), ("prev_2", F.lag, 2), ("next_1", F.lead, 1)):
        same = column(F.col(word), n).over(place) == F.col(word)
        out = out.withColumn(name, F.when(same, column(F.col(order), n).over(place)))
    return out


def validated(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """`pairs` (base, base_conf, merged) with `is_variant` (merged is a variant of base) and `valid`: for a locked base only its
    variants, else also compounds that are no base. Lookups are joins with the edge table, which Spark broadcasts if it is small."""
    own = edges.filter("compound IS NOT NULL").select("base", F.col("compound").alias("merged"), F.lit(True).alias("__own")).distinct()
    _, free = variant_sets(edges)
    free = free.select(F.col("compound").alias("merged"), F.lit(True).alias("__free"))
    out = pairs.join(own, ["base", "merged"], "left").join(free, "merged", "left")
    is_variant = F.coalesce("__own", F.lit(False))
    return out.withColumn("is_variant", is_variant).withColumn(
        "valid", F.col("is_variant") | (~(F.col("base_conf") >= LOCKED) & F.coalesce("__free", F.lit(False)))
    ).drop("__own", "__free")


#: The candidates of a segment, the first winning where scores are equal: how many segments back and ahead its crop reaches.
REACH = {"both_2": (2, 1), "both_1": (1, 1), "right": (0, 1), "left_2": (2, 0), "left_1": (1, 0), "base": (0, 0)}


def candidate_bag(scored: DataFrame, key: str, two_back: tuple[str, ...] = (), long: list | None = None) -> DataFrame:
    """A row for each candidate of each segment: (key, seg_idx, base, base_conf, gap, first_gap, kind, merged, merged_conf, first_idx, ahead, in_a, in_b).

    `scored` has (key, seg_idx, word_index, base, base_conf), and <kind> and <kind>_conf for those kinds of REACH that were scored; seg_idx orders a key. A segment without a
    base (its crop was empty) is a gap: it has one row, without a kind. Right and both need the next segment to be of the same word. Left and both
    need the segment before to be a gap of the same word that nothing has consumed, and a base that isn't locked; `two_back` bases reach back two such gaps if there are
    two. Whether the first of some gaps is consumed is not known here: candidates are marked for both cases, `in_a` (it is not) and `in_b` (it is)."""
    near = F.struct(F.col("base").isNull().alias("gap"), F.col("word_index").alias("word"), F.col("seg_idx").alias("idx"))
    scan = KeyScan(scored, key, ["seg_idx"], long).running(__n1=Running("lag", near), __next=Running("lead", F.col("word_index")))
    scan.running(__n2=Running("lag", F.col("__n1"))).running(__n3=Running("lag", F.col("__n2")))
    rows = scan.frame()
    yes = lambda c: F.coalesce(c, F.lit(False))
    gap = [yes(F.col(f"__n{k}.gap")) for k in (1, 2, 3)]
    same = [yes(F.col(f"__n{k}.word") == F.col("word_index")) for k in (1, 2)]
    free = yes(F.col("base_conf") < LOCKED)
    one = {"a": free & gap[0] & same[0], "b": free & gap[0] & same[0] & gap[1]}
    far = F.col("base").isin(list(two_back)) & gap[1] & same[1]
    two = {"a": one["a"] & far, "b": one["b"] & far & gap[2]}
    ahead = yes(F.col("__next") == F.col("word_index"))
    starts = {0: F.col("seg_idx"), 1: F.col("__n1.idx"), 2: F.col("__n2.idx")}

    def allowed(kind: str, case: str):
        back, forth = REACH[kind]
        reaches = {0: F.lit(True), 1: one[case] & ~two[case], 2: two[case]}[back]
        return reaches & ahead if forth else reaches

    held = [kind for kind in REACH if kind in rows.columns]
    bag = F.array(*[
        F.struct(
            F.lit(kind).alias("kind"), F.col(kind).alias("merged"), F.col("base_conf" if kind == "base" else f"{kind}_conf").cast("double").alias("merged_conf"),
            starts[REACH[kind][0]].alias("first_idx"), F.lit(REACH[kind][1]).alias("ahead"), allowed(kind, "a").alias("in_a"), allowed(kind, "b").alias("in_b"),
        ) for kind in held
    ])
    able = F.filter(bag, lambda c: c["merged"].isNotNull() & (c["in_a"] | c["in_b"]))
    able = F.when(F.col("base").isNotNull(), able)  # a gap has no candidates
    first_gap = F.col("base").isNull() & ~gap[0]
    return rows.select(key, "seg_idx", "base", F.col("base_conf").cast("double").alias("base_conf"), F.col("base").isNull().alias("gap"), first_gap.alias("first_gap"), F.explode_outer(able).alias("c")).select(
        key, "seg_idx", "base", "base_conf", "gap", "first_gap", "c.*"
    )


def merged_segments(scored: DataFrame, edges: DataFrame, key: str, two_back: tuple[str, ...] = (), long: list | None = None) -> DataFrame:
    """(key, idx, first_idx, char, conf, kind, n_segs) of each unit read: from left to right, a segment that isn't consumed yet takes the best of its candidates
    (see `candidate_bag`), and these segments are consumed. A candidate counts if the variant map allows it (see `validated`); right and both score BONUS more for a variant of the base.

    No segment waits for the one before it. Only a merge ahead consumes what comes later, one segment, so whether a segment is consumed is one bit. Within a run of
    segments that would merge ahead, every second one does; a segment that wouldn't ends the run. The one thing that reaches past a run is whether the gap after it
    is consumed. So both cases are worked out for each run, and for each gap what becomes of the bit (kept, turned, or settled), and the bit at a gap is the last
    settled one, turned as often as gaps since then turn it. All of these are running sums and last values; a long key is scanned by blocks."""
    bag = candidate_bag(scored, key, two_back, long)
    checked = validated(bag, edges)
    locked = F.coalesce(F.col("base_conf") >= LOCKED, F.lit(False))
    counts = (F.col("kind") == "base") | (F.col("valid") & (~locked | (F.col("kind") == "right")))
    score = F.col("merged_conf") + F.when(F.col("is_variant") & (F.col("ahead") == 1), BONUS).otherwise(0.0)
    place = F.coalesce(*[F.when(F.col("kind") == kind, k) for k, kind in enumerate(REACH)])
    entry = F.struct((-score).alias("down"), place.alias("place"), "first_idx", "ahead", "merged", "merged_conf", "kind")
    best = lambda case: F.min(F.when(counts & F.col(f"in_{case}"), entry))
    rows = checked.groupBy(key, "seg_idx", "gap", "first_gap").agg(best("a").alias("a"), best("b").alias("b"))

    scan = KeyScan(rows, key, ["seg_idx"], long).running(__n=Running("sum", F.lit(1)))
    can = {c: F.coalesce(F.col(f"{c}.ahead") == 1, F.lit(False)) for c in "ab"}
    scan.running(**{f"__stop_{c}": Running("max", F.when(~can[c], F.col("__n"))) for c in "ab"})
    merges = lambda c: can[c] & ((F.col("__n") - F.coalesce(f"__stop_{c}", F.lit(0))) % 2 == 1)
    scan.running(**{f"__eaten_{c}": Running("lag", merges(c)) for c in "ab"})
    scan.map(lambda d: d.withColumns({f"__eaten_{c}": F.coalesce(f"__eaten_{c}", F.lit(False)) for c in "ab"}))
    turned = F.col("first_gap") & F.col("__eaten_a") & ~F.col("__eaten_b")
    settled = F.col("first_gap") & (F.col("__eaten_a") == F.col("__eaten_b"))
    scan.running(__turns=Running("sum", turned.cast("int")))
    known = F.when(settled, F.struct(F.col("__eaten_a").cast("int").alias("bit"), F.col("__turns").alias("turns")))
    scan.running(__known=Running("last", known))
    consumed_gap = (F.coalesce(F.col("__known.bit") + F.col("__turns") - F.col("__known.turns"), F.lit(0)) % 2) == 1
    pick = lambda c: F.when(consumed_gap, F.col(c.format("b"))).otherwise(F.col(c.format("a")))
    found = scan.frame().filter(~F.col("gap") & ~pick("__eaten_{}")).withColumn("w", pick("{}"))
    reached = F.coalesce(*[F.when(F.col("w.kind") == kind, 1 + (back > 0) + forth) for kind, (back, forth) in REACH.items()])
    return found.select(
        key, F.col("seg_idx").cast("int").alias("idx"), F.col("w.first_idx").cast("int").alias("first_idx"), F.col("w.merged").alias("char"),
        F.col("w.merged_conf").alias("conf"), F.regexp_replace("w.kind", "_.", "").alias("kind"), reached.alias("n_segs"),
    )


def recognised(scored: DataFrame, edges: DataFrame, key: str) -> DataFrame:
    """(key, idx, char, conf, n_segs): `merged_segments` where only single segments and pairs were scored (seg_idx, word_index, base, base_conf, merged,
    merged_conf), `merged` being the top class of the segment with its right neighbour."""
    told = scored.select(key, "seg_idx", "word_index", "base", "base_conf", F.col("merged").alias("right"), F.col("merged_conf").alias("right_conf"))
    return merged_segments(told, edges, key).select(key, "idx", "char", "conf", "n_segs")


def assembled(chars: DataFrame, key: str, order: str, char: str, word: str) -> DataFrame:
    """(key, text, text_no_spaces, n_words): characters in order, with a space wherever the word index changes from the one before.
    n_words is the greatest word index plus one."""
    place = Window.partitionBy(key).orderBy(order)
    before = F.lag(word).over(place)
    gap = F.when(before.isNotNull() & (before != F.col(word)), " ").otherwise("")
    marked = chars.withColumn("__shown", F.concat(gap, F.col(char)))
    joined = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, c))), lambda s: s[c]), "")
    return marked.groupBy(key).agg(
        joined("__shown").alias("text"), joined(char).alias("text_no_spaces"), (F.coalesce(F.max(word), F.lit(-1)) + 1).alias("n_words")
    )
