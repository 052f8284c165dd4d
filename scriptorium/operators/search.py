"""Parameter search: legal values, search settings from a grid's correlations, probes, and a pattern search for all images at once."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.functions.text import bound
from scriptorium.sources.shared import cut

# Limits of each parameter, and the steps that a search starts with.
LIMITS = {"smoothing_k": (1.0, 9.0), "close_k": (1.0, 9.0), "window_pad": (2.0, 40.0), "multi_seg_threshold": (80.0, 100.0)}
STEPS = {"smoothing_k": 2.0, "close_k": 1.0, "window_pad": 4.0, "multi_seg_threshold": 1.0}
INFLUENCE = ("multi_seg_threshold", "window_pad", "close_k", "smoothing_k")
PARAMS = list(LIMITS)
ODD = ("smoothing_k", "close_k")
SETTLED_STEP = 0.1


def clamp(param: str, value: Column) -> Column:
    """The legal value nearest to `value`: an odd whole number (the lower of two equally near), a whole number, or one decimal, half-even."""
    low, high = LIMITS[param]
    v = F.greatest(F.lit(low), F.least(F.lit(high), value.cast("double")))
    if param in ODD:
        n = F.greatest(F.bround(v, 0), F.lit(1.0))
        below, above = F.greatest(n - 1, F.lit(1.0)), n + 1
        return F.when(n % 2 == 1, n).otherwise(F.when(F.abs(v - below) <= F.abs(v - above), below).otherwise(above))
    return F.bround(v, 0 if param == "window_pad" else 1)


def clamp_all(rows: DataFrame, prefix: str = "") -> DataFrame:
    return rows.withColumns({prefix + p: clamp(p, F.col(prefix + p)) for p in PARAMS})


@dataclass(frozen=True)
class SearchSettings:
    influence: tuple[str, ...] = INFLUENCE
    steps: dict[str, float] = field(default_factory=lambda: dict(STEPS))
    diagonals: tuple[tuple[str, str], ...] = ()
    tiebreak: str = "multi_seg_threshold"


def settings_from(r: dict[str, float], ratios: dict[tuple[str, str], float]) -> SearchSettings:
    """Settings from the correlations (as of `response.correlations`) and slope ratios: parameters by |r|; steps half as long
    again where |r| is at most a tenth of the greatest; pairs with a ratio of at least 0.7 move together; ties go to
    high values of the parameter with the least r. Defaults without correlations."""
    if not r:
        return SearchSettings()
    size = {p: abs(r.get(p, 0.001)) for p in PARAMS}
    most = max(size.values())
    steps = {p: STEPS[p] * (1.5 if most > 0 and size[p] / most <= 0.1 else 1.0) for p in PARAMS}
    pairs, seen = [], set()
    for a in PARAMS:
        for b in PARAMS:
            if a != b and frozenset((a, b)) not in seen and abs(ratios.get((a, b), 0.0)) >= 0.7:
                seen.add(frozenset((a, b)))
                pairs.append((a, b))
    influence = tuple(sorted(PARAMS, key=lambda p: -abs(r.get(p, 0.0))))
    return SearchSettings(influence, steps, tuple(pairs), min((p for p in PARAMS if p in r), key=r.get, default="multi_seg_threshold"))


def _moves(settings: SearchSettings) -> list[tuple[tuple[str, ...], int, str]]:
    """(parameters moved, sign, note) of a sweep's probes by ordinal: pairs together, then parameters alone, each up and down."""
    moves = [((a, b), f"({a},{b})") for a, b in settings.diagonals] + [((p,), p) for p in settings.influence]
    return [(moved, sign, f"{'diagonal' if len(moved) == 2 else 'coord'} {mark} {name}") for moved, name in moves for sign, mark in ((1, "+"), (-1, "-"))]


def _note(ordinal: Column, settings: SearchSettings) -> Column:
    return F.get(F.array(*[F.lit(note) for *_, note in _moves(settings)]), ordinal)


def _with_options(rows: DataFrame, settings: SearchSettings) -> DataFrame:
    """`rows` with `__options`, a row's probes as an array of (ordinal, parameters), made legal; of equal ones the first, none equal to the row's own point.

    All probes are put together from three legal values of each parameter, computed once in columns of their own, and are told apart by plain
    comparisons: within a lambda or an array function Spark interprets an expression anew for each element."""
    step = {p: F.col(f"step_{p}") if f"step_{p}" in rows.columns else F.lit(settings.steps[p]) for p in PARAMS}
    legal = {f"__{at}_{p}": clamp(p, F.col(p) + sign * step[p]) if sign else clamp(p, F.col(p)) for p in PARAMS for at, sign in (("at", 0), ("up", 1), ("down", -1))}
    places = [{p: F.col(f"__{('up' if sign > 0 else 'down') if p in moved else 'at'}_{p}") for p in PARAMS} for moved, sign, _ in _moves(settings)]
    same = lambda x, y: reduce(lambda a, b: a & b, [x[p] == y[p] for p in PARAMS])
    earlier = [{p: F.col(f"__at_{p}") for p in PARAMS}]
    options = []
    for k, place in enumerate(places):
        new = ~reduce(lambda a, b: a | b, [same(place, x) for x in earlier])
        options.append(F.when(new, F.struct(F.lit(k).alias("ordinal"), *[place[p].alias(p) for p in PARAMS])))
        earlier.append(place)
    return rows.withColumns(legal).withColumn("__options", F.array_compact(F.array(*options))).drop(*legal)


def probes(centres: DataFrame, settings: SearchSettings) -> DataFrame:
    """(centre's key columns, ordinal, note, parameters) of each centre's probes: pairs together, then parameters alone, each
    up and down by its step (columns step_<param>, else the settings'), made legal; of equal ones the first, none equal to the centre."""
    keys = [c for c in centres.columns if c not in PARAMS and not c.startswith("step_")]
    found = _with_options(centres, settings).select(*keys, F.explode("__options").alias("o"))
    return found.select(*keys, "o.ordinal", _note(F.col("o.ordinal"), settings).alias("note"), *[f"o.{p}" for p in PARAMS])


def pattern_search(
    start: DataFrame, score: Callable[[DataFrame], DataFrame], settings: SearchSettings | None = None, max_hops: int = 10, min_delta: float = 0.1
) -> DataFrame:
    """The end of `pattern_search_log`: (stem, parameters, best_cer, hops)."""
    return pattern_search_log(start, score, settings, max_hops, min_delta)[0]


def pattern_search_log(
    start: DataFrame, score: Callable[[DataFrame], DataFrame], settings: SearchSettings | None = None, max_hops: int = 10, min_delta: float = 0.1
) -> tuple[DataFrame, DataFrame]:
    """(stem, parameters, best_cer, hops) from `start` (stem, parameters, cer), and the log of all evaluations: (stem, hop_number,
    phase, parameters, cer, accepted, note).

    A sweep tries every probe around an image's best point; a probe that is better than the best so far by more than `min_delta` becomes the best,
    in probe order. A sweep without gain halves the image's steps, and the image rests when the tie-break parameter's step
    falls under SETTLED_STEP, its probes run out, or it has had `max_hops` evaluations. `score` maps
    (stem, ordinal, note, parameters) to the same rows with `cer` (null for a failure). All images advance together: a sweep is one plan, and
    there are at most max_hops sweeps with evaluations, each after the last one's rows are cut from their lineage. No point of an image is scored twice: its points so far,
    max_hops and the start at most, stay in its row, and a later sweep that comes back to one takes its rate from there. It counts as an evaluation all the same, as it does in the log.

    An image is one row throughout. Only the probes to be scored leave it, and their rates come back as one row of sums an image, made
    where the scorer's rows are, so a sweep shuffles one short row and the state of each image that still moves; those at rest stay where they are.
    """
    settings = settings or SearchSettings()
    steps = {f"step_{p}": F.lit(float(settings.steps[p])) for p in PARAMS}
    point = ", ".join(f"{p}: double" for p in PARAMS)
    no_past = F.array().cast(f"array<struct<ordinal: int, {point}, cer: double, took: boolean>>")
    no_probes = F.array().cast(f"array<struct<ordinal: int, {point}, known: boolean, cer: double>>")

    def with_probes(rows: DataFrame) -> DataFrame:
        """`tried`: the next sweep's probes of images that still move, as many as they have hops left, with the rates of those that were scored before."""
        own = F.slice("__options", F.lit(1), F.greatest(F.lit(max_hops) - F.col("hops"), F.lit(0)))
        seen = lambda o: F.get(F.filter("past", lambda s: reduce(lambda a, b: a & b, [s[p] == o[p] for p in PARAMS])), F.lit(0))
        told = lambda o, s: F.struct(o["ordinal"].alias("ordinal"), *[o[p].alias(p) for p in PARAMS], s.isNotNull().alias("known"), s["cer"].alias("cer"))
        tried = F.when(F.col("live"), F.transform(own, lambda o: bound(seen(o), lambda s: told(o, s)))).otherwise(no_probes)
        return _with_options(rows, settings).withColumn("tried", tried).drop("__options")

    begin = start.select("stem", *[F.col(p).cast("double").alias(p) for p in PARAMS], F.col("cer").cast("double").alias("best_cer")).withColumns(steps)
    first = F.struct(F.lit(None).cast("int").alias("ordinal"), *PARAMS, F.col("best_cer").alias("cer"), F.lit(None).cast("boolean").alias("took"))
    begin = begin.withColumns({"hops": F.lit(0), "live": F.col("stem").isNotNull() & (F.lit(max_hops) > 0), "past": F.array(first)})
    # a row is few bytes and much work, so the rows of a small file go to all cores
    begin = begin.repartition(2 * start.sparkSession.sparkContext.defaultParallelism, "stem")
    state, rested = cut(with_probes(begin)), []
    while True:
        rested.append(state.filter("NOT live").drop("tried"))
        live = state.filter("live")
        if live.isEmpty():
            break
        asked = live.select("stem", F.explode(F.filter("tried", lambda t: ~t["known"])).alias("t"))
        asked = asked.select("stem", "t.ordinal", _note(F.col("t.ordinal"), settings).alias("note"), *[f"t.{p}" for p in PARAMS])
        # a rate for each ordinal, and which were rated: sums of fixed size, so rows of an image meet before they are shuffled
        rates = [F.max(F.when(F.col("ordinal") == k, F.col("cer").cast("double"))).alias(f"__cer{k}") for k in range(len(_moves(settings)))]
        rated = score(asked).groupBy(F.col("stem").alias("__stem")).agg(F.bit_or(F.expr("shiftleft(1L, ordinal)")).alias("__rated"), *rates)
        joined = live.join(rated, F.col("stem") == F.col("__stem"), "left")
        has = lambda t: t["known"] | (F.expr("coalesce(__rated, 0L)").bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), t["ordinal"])) != 0)
        rate = lambda t: F.when(t["known"], t["cer"]).otherwise(F.get(F.array(*[f"__cer{k}" for k in range(len(rates))]), t["ordinal"]))
        got = F.transform(F.filter("tried", has), lambda t: F.struct(t["ordinal"].alias("ordinal"), *[t[p].alias(p) for p in PARAMS], rate(t).alias("cer")))
        now = F.struct(F.col("best_cer").alias("cer"), *PARAMS)
        gains = lambda best, t: F.coalesce(best["cer"] - t["cer"] > min_delta, F.lit(False))
        taken = lambda t: F.struct(t["cer"].alias("cer"), *[t[p].alias(p) for p in PARAMS])
        entry = lambda t, took: F.struct(*[t[c].alias(c) for c in ("ordinal", *PARAMS, "cer")], took.alias("took"))
        # as many probes as an image has hops left: they are few
        fold = lambda s, t: bound(gains(s["best"], t), lambda took: F.struct(F.when(took, taken(t)).otherwise(s["best"]).alias("best"), F.concat(s["told"], F.array(entry(t, took))).alias("told")))
        done = F.aggregate(got, F.struct(now.alias("best"), no_past.alias("told")), fold)
        joined = joined.select("stem", "best_cer", *steps, "hops", "past", done.alias("__done"))
        n, best = F.size("__done.told"), F.col("__done.best")
        dry = ~(best["cer"] < F.col("best_cer"))
        step = {name: F.when(dry, F.col(name) * 0.5).otherwise(F.col(name)).alias(name) for name in steps}
        settled = dry & (step[f"step_{settings.tiebreak}"] < SETTLED_STEP)
        alive = (n > 0) & (F.col("hops") + n < max_hops) & ~settled
        state = joined.select(
            "stem", *[best[p].alias(p) for p in PARAMS], best["cer"].alias("best_cer"), *step.values(), (F.col("hops") + n).alias("hops"), alias_bool(alive),
            F.concat("past", "__done.told").alias("past"),
        )
        state = cut(with_probes(state))
    ended = reduce(DataFrame.unionByName, rested)
    hop = ended.select("stem", F.posexplode("past").alias("hop_number", "t")).filter("hop_number > 0")  # the first is the start
    log = hop.select(
        "stem", "hop_number", F.lit("climb").alias("phase"), *[f"t.{p}" for p in PARAMS],
        F.bround("t.cer", 4).alias("cer"), F.col("t.took").alias("accepted"), _note(F.col("t.ordinal"), settings).alias("note"),
    )
    return ended.select("stem", *PARAMS, "best_cer", "hops"), log


def alias_bool(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False)).alias("live")


def improvement_summary(found: DataFrame, start: DataFrame, min_delta: float = 0.1) -> DataFrame:
    """One row: images, those improved by more than `min_delta`, and the mean gain."""
    gain = F.col("cer") - F.col("best_cer")
    return found.join(start.select("stem", "cer"), "stem").agg(
        F.count("*").alias("n_images"), F.count_if(gain > min_delta).alias("n_improved"), F.avg(gain).alias("mean_gain")
    )


def climb_summary(found: DataFrame, start: DataFrame) -> DataFrame:
    """(stem, parameters, grid_best_cer, best_cer, continuous_gain, pipeline_runs) of each image; rates have four decimals."""
    both = found.join(start.select("stem", F.col("cer").cast("double").alias("__start")), "stem")
    four = lambda c: F.bround(c, 4)
    return both.select(
        "stem", *[p for p in PARAMS if p in found.columns], four(F.col("__start")).alias("grid_best_cer"), four(F.col("best_cer")).alias("best_cer"),
        four(F.col("__start") - F.col("best_cer")).alias("continuous_gain"), F.col("hops").alias("pipeline_runs"),
    )
