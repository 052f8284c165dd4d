"""URL allow and block rules by a sort-merge range join; DataFrame operations only.

The canonical key of a host is its labels in reverse order, each followed by a dot (`org.example.` for `example.org`), so
that a rule's host and all its subdomains are one interval of keys, [key, key with its last dot raised to the next
character). The paths under a rule are, within its host, the interval [path, path + 0xFF) of UTF-8 bytes, which never hold
0xFF. Intervals of prefixes are nested or disjoint. Two sorted sweeps follow each other: over hosts, for all rules' hosts that
hold a page's host, and over (rule's host, path), for the longest rule's path that holds the page's. In a
sweep, points and interval ends are sorted together, a running sum of opened less closed intervals is the height of
the stack, and the rule at a height is the last one opened to it.

Keys are cut into blocks at bounds from a bounded sample. An interval is told to all blocks it reaches, so each block
begins with the stack handed over to it. A key that stands at several bounds is dealt over the blocks between them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Kinds of events, in their order at one key. An interval ends before what lies at its end.
CLOSE, OPEN, POINT = 0, 1, 2
#: Sampled keys for each block, bytes of each, and the most blocks that are cut without being asked for.
SAMPLED, KEY_BYTES, MOST_BLOCKS = 16, 256, 1024
#: Equal rows are counted in so many parts, so that none of them is returned by one task.
GRAINS = 1024


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or a url without `://`."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url)))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def host_key(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def rules_frame(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """Rules (verdict, host, path) as a table."""
    return spark.createDataFrame(rules, "verdict string, rule_host string, rule_path string")


def _count_below(bounds: list[bytes], key: Column, or_equal: bool) -> Column:
    """How many of the sorted bounds are below the key (or equal to it): a binary search in steps of halving width."""
    if not bounds:
        return F.lit(0)
    held = F.array(*[F.lit(b) for b in bounds])
    widths = [1 << k for k in reversed(range(len(bounds).bit_length()))]

    def step(low: Column, width: Column) -> Column:
        at = F.get(held, low + width - 1)
        return F.when(F.coalesce(at <= key if or_equal else at < key, F.lit(False)), low + width).otherwise(low)

    return F.aggregate(F.array(*[F.lit(w) for w in widths]), F.lit(0), step)


def choose_bounds(keys: list[bytes], blocks: int) -> list[bytes]:
    """Up to blocks - 1 bounds that deal the sampled keys evenly; a frequent key stands several times."""
    keys = sorted(keys)
    return [keys[len(keys) * k // blocks] for k in range(1, blocks)] if keys else []


def block_of(key: Column, row: Column, bounds: list[bytes]) -> Column:
    """The block of a point. Rows without a key, and those of a key that stands at several bounds, are dealt by a hash of `row`, the number that
    the row was given when it was read: a task that runs again deals them alike, in whatever order they reach it."""
    below, upto = _count_below(bounds, key, False), _count_below(bounds, key, True)
    scatter = F.xxhash64(row)
    return F.when(key.isNull(), F.pmod(scatter, F.lit(len(bounds) + 1))).otherwise(upto - F.pmod(scatter, F.greatest(upto - below, F.lit(1)))).cast("int")


def sweep(points: DataFrame, intervals: DataFrame, bounds: list[bytes], levels: int | None) -> DataFrame:
    """`points` (with `__key`, binary; null lies in no interval; and `__row`, long) with `__open`: the rules of the intervals that hold the key. `intervals` are
    (start, end, rule), nested or disjoint, each once. With `levels`, the stack as an array, outermost first, where
    `levels` is at least its greatest height; without, its top."""
    points = points.withColumn("__block", block_of(F.col("__key"), F.col("__row"), bounds))
    points = points.withColumns({"__key": F.coalesce("__key", F.lit(b"")), "__kind": F.lit(POINT), "__rule": F.lit(None).cast(intervals.schema["rule"].dataType)})
    low = F.least(_count_below(bounds, F.col("start"), False) + 1, _count_below(bounds, F.col("start"), True))
    told = intervals.withColumn("__block", F.explode(F.sequence(low, _count_below(bounds, F.col("end"), False))))
    ends = F.array(F.struct(F.col("start").alias("key"), F.lit(OPEN).alias("kind")), F.struct(F.col("end").alias("key"), F.lit(CLOSE).alias("kind")))
    events = told.select("__block", F.explode(ends).alias("e"), F.col("rule").alias("__rule")).select(
        "__block", F.col("e.key").alias("__key"), F.col("e.kind").alias("__kind"), "__rule"
    )
    order = ["__key", "__kind"]
    run = Window.partitionBy("__block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    change = F.when(F.col("__kind") == OPEN, 1).when(F.col("__kind") == CLOSE, -1).otherwise(0)
    swept = points.unionByName(events, allowMissingColumns=True).withColumn("__height", F.sum(change).over(run))
    opened = F.when(F.col("__kind") == OPEN, F.col("__rule"))
    if levels is None:
        at_height = Window.partitionBy("__block", "__height").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        swept = swept.withColumn("__open", F.when(F.col("__height") > 0, F.last(opened, ignorenulls=True).over(at_height)))
    else:
        slots = [F.last(F.when(F.col("__height") == n, opened), ignorenulls=True).over(run) for n in range(1, levels + 1)]
        stack = F.slice(F.array(*slots), F.lit(1), F.col("__height").cast("int")) if slots else F.array().cast("array<string>")
        swept = swept.withColumn("__open", stack)
    return swept.filter(F.col("__kind") == POINT).drop("__block", "__kind", "__rule", "__height")


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", blocks: int | None = None, id_col: str = "page_id") -> DataFrame:
    """(id, host, path, rule, verdict) for each row of `pages`: the longest rule (host and path
    together) that fits, else null and `default`.

    Null or malformed urls have an empty host and path and no rule. Repeated rows are all returned, and rows without an
    id are rows; other columns are ignored, whatever their names. Texts of any length count whole. Of two rules with one host and path,
    block counts; of two rules of equal length that both fit (a longer host with a shorter path), that with the greater string. A null
    host or path of a rule is empty. Empty pages give no rows; without rules all rows have the default.
    `blocks` (as many as shuffle partitions, if not given) changes the plan, not the result. Rows are numbered where `pages` is read, so
    it should come from files: those of a frame that is itself shuffled may get other numbers when a task runs again.
    """
    spark = pages.sparkSession
    blocks = blocks or min(MOST_BLOCKS, max(2, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    host, path = split_url(F.col("__url"))
    pages = pages.select(F.col(f"`{id_col}`").alias("__id"), F.col("url").alias("__url")).select("__id", host.alias("host"), path.alias("path"))
    rule_host = F.translate(F.coalesce("rule_host", F.lit("")), UPPER, LOWER)
    rules = rules.select(rule_host.alias("rule_host"), F.coalesce("rule_path", F.lit("")).alias("rule_path"), "verdict")
    rules = rules.filter(~F.contains("rule_host", F.lit("/")))  # no url has such a host
    rules = rules.groupBy("rule_host", "rule_path").agg(F.max(F.struct((F.col("verdict") == "block").alias("b"), "verdict")).verdict.alias("verdict"))
    levels = rules.select(F.max(F.size(F.split("rule_host", r"\."))).alias("n")).first().n or 0

    key = host_key(F.col("rule_host"))
    hosts = rules.select("rule_host").distinct().select(
        key.cast("binary").alias("start"), F.concat(key.substr(F.lit(1), F.length(key) - 1), F.lit("/")).cast("binary").alias("end"), F.col("rule_host").alias("rule")
    )
    whole = F.concat("rule_host", F.lit("/"), "rule_path")
    paths = rules.select(
        whole.cast("binary").alias("start"), F.concat(whole.cast("binary"), F.lit(b"\xff")).alias("end"),
        F.struct(F.length(F.concat("rule_host", "rule_path")).alias("n"), F.concat("rule_host", "rule_path").alias("rule"), "verdict").alias("rule"),
    )

    def by_host(rows: DataFrame, bounds: list[bytes]) -> DataFrame:
        """A row with no key for each page, and one for each rule's host that holds its host, with rule's host and path as the key."""
        found = sweep(rows.withColumn("__key", host_key(F.col("host")).cast("binary")), hosts, bounds, levels)
        found = found.drop("__key").withColumn("__rule_host", F.explode(F.concat(F.array(F.lit(None).cast("string")), "__open"))).drop("__open")
        return found.withColumn("__key", F.concat("__rule_host", F.lit("/"), "path").cast("binary"))

    def collected(keys: Column, rows: DataFrame) -> list[bytes]:
        return [bytes(r.k) for r in rows.select(F.substring(keys, 1, KEY_BYTES).alias("k")).collect() if r.k is not None]

    # SAMPLED keys a block, of KEY_BYTES at most, are all that reaches the driver
    sample = pages.select(F.substring("host", 1, KEY_BYTES).alias("host"), F.substring("path", 1, KEY_BYTES).alias("path"))
    sample = sample.orderBy(F.xxhash64(F.monotonically_increasing_id())).limit(SAMPLED * blocks)
    drawn = spark.createDataFrame(sample.collect(), sample.schema).withColumn("__row", F.lit(0).cast("long"))
    bounds = choose_bounds(collected(host_key(F.col("host")).cast("binary"), drawn), blocks)
    path_bounds = choose_bounds(collected(F.col("__key"), by_host(drawn, bounds)), blocks)

    numbered = pages.withColumn("__row", F.monotonically_increasing_id())
    swept = sweep(by_host(numbered, bounds), paths, path_bounds, None)
    best = swept.withColumn("__grain", F.pmod("__row", F.lit(GRAINS)).cast("int")).groupBy("__id", "host", "path", "__grain").agg(
        F.sum(F.col("__rule_host").isNull().cast("long")).alias("rows"), F.max("__open").alias("best")
    )
    return best.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), "rows"))).select(
        F.col("__id").alias(id_col), "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict")
    )
