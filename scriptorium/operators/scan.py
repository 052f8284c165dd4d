"""Running values along a key of any length: block-wise prefix scans.

A window puts all rows of a key in one task. That is right for most keys; a key that holds a large share of all rows is instead
cut into blocks by order. Each block is scanned by itself and summed up in one row; the summaries, a row a block, are scanned in their turn; and what
comes before a block (the running sum, the greatest, the last value) is handed into it by a broadcast join. Values of
all operations here can be put together so, whatever the cuts.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.sources.shared import cut

#: A key is long if it holds more than one part in SHARE of all rows, so there are SHARE long keys at most, and more than LONG_ROWS rows.
SHARE, LONG_ROWS = 256, 1 << 16
#: Blocks for each task, so that tasks of whole blocks are of like size.
FINER = 4


def long_keys(rows: DataFrame, key: str, long_rows: int | None = None) -> list:
    """The values of `key`, null too, that are long (see above)."""
    least = LONG_ROWS if long_rows is None else long_rows
    most = [r for r in rows.groupBy(key).agg(F.count("*").alias("__n")).orderBy(F.desc("__n")).limit(SHARE).collect() if r["__n"] > least]
    if not most:
        return []
    total = rows.count()
    return [r[key] for r in most if r["__n"] * SHARE > total]


def is_one_of(key: str, values: list) -> Column:
    known = [v for v in values if v is not None]
    found = F.coalesce(F.col(key).isin(known), F.lit(False)) if known else F.lit(False)
    return found | F.col(key).isNull() if len(known) < len(values) else found


@dataclass(frozen=True)
class Running:
    """A value that runs along a key: the `sum`, `max` or `min` of those so far, the `last` that isn't null, or the neighbour's (`lag`, `lead`).
    With `before` the row itself doesn't count."""

    op: str
    value: Column
    before: bool = False

    def over(self, by: list[str], order: list) -> Column:
        place = Window.partitionBy(*by).orderBy(*order)
        if self.op in ("lag", "lead"):
            return (F.lag if self.op == "lag" else F.lead)(self.value).over(place)
        frame = place.rowsBetween(Window.unboundedPreceding, -1 if self.before else 0)
        return (F.last(self.value, ignorenulls=True) if self.op == "last" else getattr(F, self.op)(self.value)).over(frame)

    def summary(self, order: list) -> Column:
        """What a block hands on."""
        if self.op == "last":
            return F.max_by(self.value, F.when(self.value.isNotNull(), F.struct(*order)))
        if self.op in ("lag", "lead"):
            return (F.max_by if self.op == "lag" else F.min_by)(F.struct(self.value.alias("v")), F.struct(*order))
        return getattr(F, self.op)(self.value)

    def handed(self, own: str, key: str) -> Column:
        """What a block gets from the others of its key."""
        place = Window.partitionBy(key).orderBy("__block")
        if self.op in ("lag", "lead"):
            return (F.lag if self.op == "lag" else F.lead)(own).over(place)
        frame = place.rowsBetween(Window.unboundedPreceding, -1)
        return (F.last(own, ignorenulls=True) if self.op == "last" else getattr(F, self.op)(own)).over(frame)

    def joined(self, own: Column, handed: Column, edge: Column) -> Column:
        if self.op in ("lag", "lead"):
            return F.when(edge, handed["v"]).otherwise(own)
        if self.op == "last":
            return F.coalesce(own, handed)
        if self.op == "sum":
            return F.coalesce(own + handed, own, handed)
        return (F.greatest if self.op == "max" else F.least)(own, handed)


class KeyScan:
    """Rows by `key` in `order`, with running values; rows of long keys go by blocks. Columns of `order` are read ascending, nulls first, and leave no ties that matter.

    `long` are the long keys, if they are known; they may name keys that aren't. The result has no order of its own."""

    def __init__(self, rows: DataFrame, key: str, order: list, long: list | None = None):
        long = long_keys(rows, key) if long is None else long
        self.key, self.order = key, list(order)
        self.short, self.long = rows, None
        if long:
            blocks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
            held = rows.filter(is_one_of(key, long)).repartitionByRange(FINER * blocks, key, *order)
            # the cut fixes which rows are in which block; then some neighbouring blocks make a task
            self.long = cut(held.withColumn("__block", F.spark_partition_id())).repartitionByRange(blocks, "__block")
            self.short = rows.filter(~is_one_of(key, long))

    def map(self, change: Callable[[DataFrame], DataFrame]) -> KeyScan:
        """Both kinds of rows changed by a function that looks at single rows."""
        self.short = change(self.short)
        self.long = change(self.long) if self.long is not None else None
        return self

    def running(self, finer: list | None = None, **values: Running) -> KeyScan:
        """The rows with running values. `finer` orders rows that are equal by `order` too."""
        order = self.order + (finer or [])
        self.short = self.short.withColumns({name: v.over([self.key], order) for name, v in values.items()})
        if self.long is None:
            return self
        by = ["__block", self.key]
        sums = self.long.groupBy(*by).agg(*[v.summary(order).alias(f"__{name}") for name, v in values.items()])
        # a row for each block and each key in it: blocks and keys together at most
        sums = sums.select(F.col(self.key).alias("__key"), F.col("__block").alias("__at"), *[v.handed(f"__{name}", self.key).alias(f"__{name}") for name, v in values.items()])
        place = Window.partitionBy(*by).orderBy(*order)
        edge = {"lag": F.lag(F.lit(1)).over(place).isNull(), "lead": F.lead(F.lit(1)).over(place).isNull()}
        own = self.long.withColumns({f"__own_{name}": v.over(by, order) for name, v in values.items()} | {f"__{k}_edge": c for k, c in edge.items() if any(v.op == k for v in values.values())})
        out = own.join(F.broadcast(sums), (F.col("__at") == F.col("__block")) & F.col("__key").eqNullSafe(F.col(self.key)))
        out = out.withColumns({name: v.joined(F.col(f"__own_{name}"), F.col(f"__{name}"), F.col(f"__{v.op}_edge") if v.op in edge else F.lit(False)) for name, v in values.items()})
        self.long = out.select(*dict.fromkeys([*self.long.columns, *values]))
        return self

    def totals(self, **values: Column) -> KeyScan:
        """The rows with aggregates over all of their key."""
        whole = Window.partitionBy(self.key)
        self.short = self.short.withColumns({name: v.over(whole) for name, v in values.items()})
        if self.long is not None:
            each = self.long.groupBy(F.col(self.key).alias("__key")).agg(*[v.alias(name) for name, v in values.items()])  # a row a long key
            self.long = self.long.join(F.broadcast(each), F.col("__key").eqNullSafe(F.col(self.key))).drop("__key")
        return self

    def frame(self) -> DataFrame:
        return self.short if self.long is None else self.short.unionByName(self.long.drop("__block"))


def numbered(rows: DataFrame, *order: Column | str, name: str = "k") -> DataFrame:
    """`rows` with `name`, their place (from 1) in `order` over the whole table, without bringing them to one task: rows are cut into ranges of the order, each is
    numbered by itself, and the counts of those before it are added. Rows that are equal by `order` stay in one range and are numbered in any order among them."""
    blocks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut(rows.repartitionByRange(FINER * blocks, *order).withColumn("__block", F.spark_partition_id()))
    before = Window.orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)  # a row a block
    starts = dealt.groupBy("__block").agg(F.count("*").alias("__n")).select("__block", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    place = F.row_number().over(Window.partitionBy("__block").orderBy(*order))
    return dealt.repartitionByRange(blocks, "__block").withColumn(name, place).join(F.broadcast(starts), "__block").withColumn(name, F.col(name) + F.col("__start")).drop("__block", "__start")


def quota_cut(rows: DataFrame, strata: list[str], order: list[Column | str], quota: Callable[[Column], Column], bins: int = 4096, name: str = "within") -> DataFrame:
    """`rows` with a boolean `name`: whether the row is among the first quota(n) of the n rows of its stratum, in `order`.

    No stratum is sorted whole. The first column of `order`, a number, falls into `bins` equal bins between its least and greatest value in the stratum; the counts by
    bin tell in which bin the quota ends. Rows of lower bins are within, those of higher ones aren't, and only the rows of that bin are ranked, by a block-wise scan
    if many share it. Null strata are strata of their own, and null values come first."""
    first = (F.col(order[0]) if isinstance(order[0], str) else order[0]).cast("double")
    held = rows.withColumn("__v", first)
    size = held.groupBy(*strata).agg(F.count("*").alias("__n"), F.min("__v").alias("__low"), F.max("__v").alias("__high"))
    size = cut(size.withColumn("__quota", quota(F.col("__n"))))  # a row a stratum
    binned = _beside(held, size.select(*strata, "__low", "__high", "__quota"), strata)
    step = (F.col("__v") - F.col("__low")) / F.nullif(F.col("__high") - F.col("__low"), F.lit(0.0)) * bins
    binned = binned.withColumn("__bin", F.when(F.col("__v").isNull(), -1).otherwise(F.least(F.floor(F.coalesce(step, F.lit(0.0))), F.lit(bins - 1)))).drop("__v", "__low", "__high")
    counts = binned.groupBy(*strata, "__bin").agg(F.count("*").alias("__n"), F.first("__quota").alias("__quota"))
    upto = Window.partitionBy(*strata).orderBy("__bin")  # bins at most in a stratum
    counts = counts.withColumn("__upto", F.sum("__n").over(upto))
    last = counts.filter(F.col("__upto") >= F.col("__quota")).groupBy(*strata).agg(
        F.min(F.struct("__bin", (F.col("__upto") - F.col("__n")).alias("__before"))).alias("__end")
    )
    last = cut(last)
    told = _beside(binned, last.select(*strata, F.col("__end.__bin").alias("__cut"), F.col("__end.__before").alias("__before")), strata)
    clear = told.filter(F.col("__bin") != F.col("__cut")).withColumn(name, F.col("__bin") < F.col("__cut"))
    group = F.concat_ws("\u0000", *[F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("")) for c in strata])
    ties = KeyScan(told.filter(F.col("__bin") == F.col("__cut")).withColumn("__stratum", group), "__stratum", order).running(__k=Running("sum", F.lit(1)))
    within = ties.frame().withColumn(name, F.col("__k") + F.col("__before") <= F.col("__quota")).drop("__k", "__stratum")
    return clear.unionByName(within).select(*rows.columns, name)


#: Rows of a small side that is sent to every task; a larger one is joined by shuffle, where adaptive plans split hot keys.
SMALL = 10_000


def _beside(rows: DataFrame, small: DataFrame, keys: list[str]) -> DataFrame:
    """`rows` with the columns of `small`, which has a row for each combination of `keys`, nulls too."""
    renamed = small.select(*[F.col(c).alias(f"__beside_{c}") if c in keys else F.col(c) for c in small.columns])
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__beside_{c}")) for c in keys])
    few = small.limit(SMALL + 1).count() <= SMALL
    return rows.join(F.broadcast(renamed) if few else renamed, same).drop(*[f"__beside_{c}" for c in keys])
