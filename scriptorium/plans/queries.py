"""The registered queries over the provided tables, each with the SQL that gives the same rows in DuckDB.

Recognition data are stood in for by tables of the same shape: names as recognised and true text, events as ink
profiles and gaps, order dates as intervals, vectors as logits. All rows of the tables take part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.functions import text as T
from scriptorium.operators import dataset, intervals, lexicon, metrics, recognise, response, scan, search
from scriptorium.session import table
from scriptorium.sources.readers import parse_labels, variant_edges
from scriptorium.sources.shared import cut

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def six(c):
    return F.round(c, 6)


# Error rates

PAIR_SQL = """
WITH pairs AS (
  SELECT a.p_partkey AS id, a.p_brand AS brand, a.p_name AS pred, coalesce(b.p_name, '') AS ref, c.p_name AS base
  FROM part a LEFT JOIN part b ON b.p_partkey = a.p_partkey + 1 LEFT JOIN part c ON c.p_partkey = a.p_partkey + 2
), rated AS (
  SELECT *, CASE WHEN ref = '' THEN 0.0 ELSE CAST(round_even(levenshtein(pred, ref) / length(ref) * 100, 2) AS DOUBLE) END AS cer,
         CASE WHEN ref <> '' AND base IS NOT NULL THEN CAST(round_even(levenshtein(base, ref) / length(ref) * 100, 2) AS DOUBLE) END AS base_cer
  FROM pairs
)
"""


def name_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A part's name as predicted text, the next one's as truth, the one after that as baseline; the last ones lack these."""
    part = table(spark, sf_dir, "part")
    a = part.select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("brand"), F.col("p_name").alias("pred"))
    b = part.select((F.col("p_partkey") - 1).alias("id"), F.col("p_name").alias("ref"))
    c = part.select((F.col("p_partkey") - 2).alias("id"), F.col("p_name").alias("base"))
    return a.join(b, "id", "left").join(c, "id", "left").withColumn("ref", F.coalesce("ref", F.lit("")))


def rated_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = metrics.labelled(F.col("ref")) & F.col("base").isNotNull()
    return name_pairs(spark, sf_dir).withColumn("cer", T.cer(F.col("pred"), F.col("ref"))).withColumn(
        "base_cer", F.when(both, T.cer(F.col("base"), F.col("ref")))
    )


@query(PAIR_SQL + "SELECT id, cer FROM rated WHERE ref <> ''")
def q01_cer_pairs(spark, sf_dir):
    return rated_pairs(spark, sf_dir).filter(metrics.labelled(F.col("ref"))).select("id", "cer")


@query(PAIR_SQL + r""", t AS (
  SELECT id, list_filter(regexp_split_to_array(trim(pred), '\s+'), lambda w: w <> '') AS p, list_filter(regexp_split_to_array(trim(ref), '\s+'), lambda w: w <> '') AS r FROM pairs
), d AS (SELECT *, list_distinct(list_concat(p, r)) AS v FROM t
), e AS (
  SELECT id, len(r) AS n, levenshtein(array_to_string(list_transform(p, lambda x: chr(CAST(64 + list_position(v, x) AS INTEGER))), ''),
         array_to_string(list_transform(r, lambda x: chr(CAST(64 + list_position(v, x) AS INTEGER))), '')) AS ed FROM d
)
SELECT id, CASE WHEN n = 0 THEN 0.0 ELSE CAST(round_even(ed / n * 100, 2) AS DOUBLE) END AS wer FROM e
""")
def q02_wer_pairs(spark, sf_dir):
    """Word error rates of all pairs of whole names, JVM-side; for whole documents see q02b_wer_whole."""
    return name_pairs(spark, sf_dir).select("id", T.wer(F.col("pred"), F.col("ref")).alias("wer"))


@query()
def q02b_wer_whole(spark, sf_dir):
    """Each document's whole text rated against that of the next by doc_id; a document without words to compare with has 0."""
    ranked = scan.numbered(table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("pred")), "doc_id")
    other = ranked.select((F.col("k") - 1).alias("k"), F.col("pred").alias("ref"))
    return ranked.join(other, "k").select("doc_id", T.wer_long(F.col("pred"), F.col("ref")).alias("wer"))


MEAN_SQL = PAIR_SQL + """, means AS (
  SELECT brand, count(*) AS n_images, count(*) FILTER (ref <> '') AS n_labelled, round(avg(cer) FILTER (ref <> ''), 6) AS mean_cer FROM rated GROUP BY brand
) """


def brand_means(spark, sf_dir):
    found = metrics.macro_means(rated_pairs(spark, sf_dir), "brand", reference="ref")
    return found.withColumn("mean_cer", six("mean_cer"))


@query(MEAN_SQL + "SELECT * FROM means")
def q03_macro_mean(spark, sf_dir):
    return brand_means(spark, sf_dir)


@query(PAIR_SQL + """
SELECT brand, count(*) AS n_images, count(base_cer) AS n_compared, round(avg(cer) FILTER (base_cer IS NOT NULL), 6) AS mean_cer,
       round(avg(base_cer), 6) AS mean_base, count(*) FILTER (base_cer IS NOT NULL AND cer < base_cer) AS n_better FROM rated GROUP BY brand
""")
def q04_baseline_ab(spark, sf_dir):
    has = F.col("base_cer").isNotNull()
    return rated_pairs(spark, sf_dir).groupBy("brand").agg(
        F.count("*").alias("n_images"), F.count("base_cer").alias("n_compared"), six(F.avg(F.when(has, F.col("cer")))).alias("mean_cer"),
        six(F.avg("base_cer")).alias("mean_base"), F.count_if(has & (F.col("cer") < F.col("base_cer"))).alias("n_better"),
    )


@query(MEAN_SQL + "SELECT brand, mean_cer, row_number() OVER (ORDER BY mean_cer NULLS LAST, brand) AS rank FROM means ORDER BY 3 LIMIT 20")
def q05_rank_topk(spark, sf_dir):
    return metrics.ranked(brand_means(spark, sf_dir), "mean_cer", "brand").filter("rank <= 20").select("brand", "mean_cer", "rank")


# Intervals

PROFILE_SQL = """
WITH cells AS (SELECT user_id, CAST(epoch_us(ts) // 3600000000 % 96 AS INTEGER) AS x FROM events
), profile AS (
  SELECT u.user_id, x.x, count(c.x) AS ink FROM (SELECT DISTINCT user_id FROM events) u CROSS JOIN (SELECT unnest(range(0, 96)) AS x) x
  LEFT JOIN cells c ON c.user_id = u.user_id AND c.x = x.x GROUP BY 1, 2
), flagged AS (
  SELECT *, CASE WHEN (ink = 0) <> lag(ink = 0) OVER (PARTITION BY user_id ORDER BY x) THEN 1 ELSE 0 END AS f FROM profile
), numbered AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY x) AS run FROM flagged
), runs AS (
  SELECT user_id, run, min(x) AS s, max(x) + 1 AS e, bool_and(ink = 0) AS zero, count(*) AS w FROM numbered GROUP BY 1, 2
), seen AS (
  SELECT *, max(CASE WHEN zero THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY s) AS inked,
         lead(zero) OVER (PARTITION BY user_id ORDER BY s) AS next_zero FROM runs
), wide AS (SELECT *, zero AND w >= 3 AS wide FROM seen WHERE inked = 1
), segd AS (SELECT *, sum(CASE WHEN wide THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY s) - CASE WHEN wide THEN 1 ELSE 0 END AS seg FROM wide
), segments AS (
  SELECT user_id, CAST(seg AS INTEGER) AS seg_idx, min(s) FILTER (NOT zero) AS x_start,
         coalesce(min(s) FILTER (wide), max(e)) AS x_end, max(w) FILTER (wide) AS gap_after
  FROM segd GROUP BY 1, 2
)
"""


def profile(spark, sf_dir):
    """Each user's events over 96 hours, folded: a dense ink profile."""
    events = table(spark, sf_dir, "events")
    hour = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 3_600_000_000) % 96
    counts = events.groupBy("user_id", hour.cast("int").alias("x")).agg(F.count("*").alias("ink"))
    cells = events.select("user_id").distinct().select("user_id", F.explode(F.sequence(F.lit(0), F.lit(95))).alias("x"))
    return cells.join(counts, ["user_id", "x"], "left").withColumn("ink", F.coalesce("ink", F.lit(0)))


def segments(spark, sf_dir):
    return intervals.true_gaps(profile(spark, sf_dir), "user_id", 3)


@query(PROFILE_SQL + "SELECT * FROM segments")
def q10_true_gaps(spark, sf_dir):
    return segments(spark, sf_dir)


WORDS_SQL = PROFILE_SQL + """, limits AS (
  SELECT *, coalesce(avg(gap_after) OVER (PARTITION BY user_id) + 0.5 * coalesce(stddev_samp(gap_after) OVER (PARTITION BY user_id), 0), 0) AS threshold,
         lag(gap_after) OVER (PARTITION BY user_id ORDER BY seg_idx) AS before FROM segments
), words AS (
  SELECT *, CAST(sum(CASE WHEN before >= threshold THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY seg_idx) AS INTEGER) AS word_index FROM limits
), groups AS (SELECT user_id, word_index, min(x_start) AS x_start, max(x_end) AS x_end, count(*) AS n_segments FROM words GROUP BY 1, 2)
"""


def words_of(spark, sf_dir):
    return intervals.adaptive_groups(segments(spark, sf_dir), "user_id", "seg_idx", "gap_after")


def blobs_and_words(spark, sf_dir):
    """Blobs, segments and words of the profile, which is computed once, as are the segments."""
    ink = cut(profile(spark, sf_dir))
    long = scan.long_keys(ink, "user_id")
    segs = cut(intervals.adaptive_groups(intervals.true_gaps(ink, "user_id", 3, long=long), "user_id", "seg_idx", "gap_after", long=long))
    groups = segs.groupBy("user_id", "word_index").agg(F.min("x_start").alias("x_start"), F.max("x_end").alias("x_end"))
    blobs = ink.filter("ink > 0").select("user_id", F.col("x").alias("x_start"), (F.col("x") + 1 + (F.col("ink") % 2).cast("int")).alias("x_end"))
    return blobs, segs, groups, long


@query(WORDS_SQL + "SELECT user_id, seg_idx, word_index, round(threshold, 6) AS threshold FROM words")
def q11_adaptive_groups(spark, sf_dir):
    return words_of(spark, sf_dir).select("user_id", "seg_idx", "word_index", six("threshold").alias("threshold"))


SPAN_SQL = """
WITH days AS (
  SELECT l_suppkey AS key, epoch_us(o_orderdate) // 86400000000 AS o, epoch_us(l_shipdate) // 86400000000 AS s
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey
), spans AS (SELECT key, least(o, s) AS a, greatest(o, s) AS b FROM days WHERE o IS NOT NULL AND s IS NOT NULL AND o <> s
), marked AS (SELECT *, max(b) OVER (PARTITION BY key ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM spans
), islands AS (SELECT *, sum(CASE WHEN a <= m + 1 THEN 0 ELSE 1 END) OVER (PARTITION BY key ORDER BY a, b, m NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS g FROM marked)
SELECT key, min(a) AS x_start, max(b) AS x_end, count(*) AS n FROM islands GROUP BY key, g
"""


@query(SPAN_SQL)
def q12_interval_merge(spark, sf_dir):
    day = lambda c: F.floor(F.unix_micros(F.col(c).cast("timestamp")) / 86_400_000_000)
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    days = lines.select("l_orderkey", "l_suppkey", "l_shipdate").join(orders.select("o_orderkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
    days = days.select(F.col("l_suppkey").alias("key"), day("o_orderdate").alias("o"), day("l_shipdate").alias("s")).filter("o <> s")
    spans = days.select("key", F.least("o", "s").alias("a"), F.greatest("o", "s").alias("b"))
    return intervals.merge_intervals(spans, "key", "a", "b", slack=1)


BLOB_SQL = WORDS_SQL + """, blobs AS (
  SELECT user_id, x AS x_start, x + 1 + CAST(ink % 2 AS INTEGER) AS x_end FROM profile WHERE ink > 0
), inside AS (
  SELECT b.user_id, g.word_index, b.x_start, b.x_end FROM blobs b JOIN groups g ON g.user_id = b.user_id AND b.x_start >= g.x_start AND b.x_end <= g.x_end
), valley AS (
  SELECT s.user_id, g.word_index, s.x_start, s.x_end FROM segments s JOIN groups g ON g.user_id = s.user_id AND s.x_start >= g.x_start AND s.x_end <= g.x_end
)
"""


@query(BLOB_SQL + "SELECT * FROM inside")
def q13_containment(spark, sf_dir):
    blobs, _, groups, long = blobs_and_words(spark, sf_dir)
    return intervals.within_words(blobs, groups, "user_id", long).select("user_id", "word_index", "x_start", "x_end")


METHOD_SQL = BLOB_SQL + """, counted AS (
  SELECT g.user_id, g.word_index, (SELECT count(*) FROM valley v WHERE v.user_id = g.user_id AND v.word_index = g.word_index) AS nv,
         (SELECT count(*) FROM inside b WHERE b.user_id = g.user_id AND b.word_index = g.word_index) AS nb FROM groups g
), picked AS (SELECT *, CASE WHEN nv = 0 OR nb > nv THEN 'blob' ELSE 'valley' END AS method FROM counted
), fused AS (
  SELECT v.user_id, v.word_index, v.x_start, v.x_end, 'valley' AS method FROM valley v JOIN picked p USING (user_id, word_index) WHERE p.method = 'valley'
  UNION ALL
  SELECT b.user_id, b.word_index, b.x_start, b.x_end, 'blob' FROM inside b JOIN picked p USING (user_id, word_index) WHERE p.method = 'blob'
), placed AS (SELECT *, CAST(row_number() OVER (PARTITION BY user_id ORDER BY word_index, x_start, x_end) - 1 AS INTEGER) AS seg_idx FROM fused)
"""


def fused(spark, sf_dir):
    blobs, segs, groups, long = blobs_and_words(spark, sf_dir)
    return intervals.fuse_segments(segs, blobs, groups, "user_id", long)


@query(METHOD_SQL + "SELECT user_id, seg_idx, word_index, x_start, x_end, method FROM placed")
def q14_method_choice(spark, sf_dir):
    return fused(spark, sf_dir).select("user_id", "seg_idx", "word_index", "x_start", "x_end", "method")


@query(METHOD_SQL + """, words_m AS (SELECT DISTINCT user_id, word_index, method FROM placed), n AS (
  SELECT user_id, count(*) FILTER (method = 'valley') AS v, count(*) FILTER (method = 'blob') AS b FROM words_m GROUP BY 1)
SELECT user_id, concat_ws(',', CASE WHEN v > 0 THEN 'valley:' || v END, CASE WHEN b > 0 THEN 'blob:' || b END) AS summary FROM n
""")
def q14b_method_summary(spark, sf_dir):
    return intervals.method_summary(fused(spark, sf_dir).select("user_id", "word_index", "method").distinct(), "user_id")


@query(PROFILE_SQL + """
SELECT user_id, count(*) AS n_gaps, round(avg(w), 6) AS mean_gap, round(stddev_pop(w), 6) AS std_gap FROM seen WHERE zero AND next_zero IS NOT NULL GROUP BY 1
""")
def q15_gap_stats(spark, sf_dir):
    gaps = intervals.closed_gaps(profile(spark, sf_dir), "user_id")
    return gaps.groupBy("user_id").agg(F.count("*").alias("n_gaps"), six(F.avg("width")).alias("mean_gap"), six(F.stddev_pop("width")).alias("std_gap"))


THIN_SQL = PROFILE_SQL.replace("WITH cells", "WITH RECURSIVE cells", 1) + """, inks AS (SELECT user_id, list(ink ORDER BY x) AS p FROM profile GROUP BY 1
), parts(user_id, seg_idx, a, b, done) AS (
  SELECT user_id, seg_idx, x_start, x_end, false FROM segments
  UNION ALL
  SELECT user_id, seg_idx, c.a, c.b, c.done FROM (
    SELECT user_id, seg_idx, unnest(CASE WHEN b - a < 6 * 1.3 OR len(i) = 0 OR list_min(i) > 6 * 0.2 THEN [struct_pack(a := a, b := b, done := true)]
      ELSE [struct_pack(a := a, b := a + 2 + CAST(t[len(t) // 2 + 1] AS INTEGER), done := false), struct_pack(a := a + 2 + CAST(t[len(t) // 2 + 1] AS INTEGER), b := b, done := false)] END) AS c
    FROM (SELECT *, list_filter(range(0, len(i)), lambda k: i[k + 1] = list_min(i)) AS t
          FROM (SELECT parts.*, p[a + 3 : b - 2] AS i FROM parts JOIN inks USING (user_id) WHERE NOT done)))
)
SELECT user_id, seg_idx, CAST(row_number() OVER (PARTITION BY user_id, seg_idx ORDER BY a) - 1 AS INTEGER) AS part, CAST(a AS INTEGER) AS x_start, CAST(b AS INTEGER) AS x_end FROM parts WHERE done
"""


@query(THIN_SQL)
def q16_thin_split(spark, sf_dir):
    inks = profile(spark, sf_dir).groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("x", "ink"))).alias("p"))
    inks = inks.select("user_id", F.transform("p", lambda s: s["ink"].cast("int")).alias("ink"))
    return intervals.thin_splits(segments(spark, sf_dir), inks, "user_id", height=6, margin=2, thin=0.2)


# Lexicon

# The units of the stand-in lexicon, single letters and some digraphs.
UNITS = [*"abcdefghijklmnopqrstuvwxyz", "th", "er", "on", "an", "re", "nd", "in", "ti", "es", "or", "te", "at"]

LEXICON_SQL = r"""
WITH RECURSIVE words AS (
  SELECT w, count(*) AS n FROM (SELECT unnest(list_filter(regexp_split_to_array(trim(coalesce(text, '')), '\s+'), lambda x: x <> '')) AS w FROM documents) GROUP BY w
), cutting(w, n, pos, parts, ok) AS (
  SELECT w, n, 1, CAST([] AS VARCHAR[]), true FROM words
  UNION ALL
  SELECT w, n, pos + CASE WHEN substring(w, pos, 2) IN ('th','er','on','an','re','nd','in','ti','es','or','te','at') THEN 2 ELSE 1 END,
         list_append(parts, CASE WHEN substring(w, pos, 2) IN ('th','er','on','an','re','nd','in','ti','es','or','te','at') THEN substring(w, pos, 2) ELSE substring(w, pos, 1) END),
         regexp_matches(substring(w, pos, 1), '^[a-z]$')
  FROM cutting WHERE ok AND pos <= length(w)
), cut AS (SELECT w AS word, n, parts AS clusters FROM cutting WHERE ok AND pos > length(w)
), prefixes AS (
  SELECT clusters[1:d] AS prefix, d AS depth, sum(CASE WHEN d = len(clusters) THEN n ELSE 0 END) AS terminal_freq, count(*) AS subtree_types
  FROM (SELECT *, unnest(range(0, len(clusters) + 1)) AS d FROM cut) GROUP BY 1, 2
)
"""


def lexicon_cut(spark, sf_dir):
    return lexicon.segmented(lexicon.corpus_words(table(spark, sf_dir, "documents"), "text"), UNITS)


def trie(spark, sf_dir):
    return lexicon.prefix_table(lexicon_cut(spark, sf_dir))


@query(LEXICON_SQL + """
SELECT CAST((SELECT sum(n) FROM words) AS BIGINT) AS total, CAST(coalesce(sum(n), 0) AS BIGINT) AS valid,
       CAST((SELECT sum(n) FROM words) - coalesce(sum(n), 0) AS BIGINT) AS discarded, count(*) AS unique_valid FROM cut
""")
def q20_word_count(spark, sf_dir):
    return lexicon.corpus_counts(lexicon_cut(spark, sf_dir))


@query(LEXICON_SQL + "SELECT word, n, array_to_string(clusters, '.') AS clusters FROM cut")
def q21_longest_match(spark, sf_dir):
    return lexicon_cut(spark, sf_dir).filter("clusters IS NOT NULL").select("word", "n", F.array_join("clusters", ".").alias("clusters"))


@query(LEXICON_SQL + "SELECT array_to_string(prefix, '.') AS prefix, CAST(depth AS INTEGER) AS depth, CAST(terminal_freq AS BIGINT) AS terminal_freq, subtree_types FROM prefixes")
def q22_trie_prefix(spark, sf_dir):
    return trie(spark, sf_dir).select(F.array_join("prefix", ".").alias("prefix"), "depth", "terminal_freq", "subtree_types")


@query(LEXICON_SQL + r""", asked AS (
  SELECT DISTINCT unnest(list_filter(regexp_split_to_array(trim(coalesce(text, '')), '\s+'), lambda x: x <> '')) AS word FROM benchmark)
SELECT a.word, coalesce(c.n, 0) AS freq FROM asked a LEFT JOIN cut c ON c.word = a.word
""")
def q23_search(spark, sf_dir):
    asked = lexicon.corpus_words(table(spark, sf_dir, "benchmark"), "text").distinct()
    return lexicon.search(asked, lexicon_cut(spark, sf_dir))


ASKED = [["th"], ["t"], ["th", "e"], ["t", "h"], [], ["q", "z"], ["an", "d"], ["on"]]
ASKED_SQL = ", asked AS (SELECT unnest([" + ", ".join("CAST([" + ", ".join(f"'{x}'" for x in a) + "] AS VARCHAR[])" for a in ASKED) + "]) AS prefix)"


def asked_prefixes(spark):
    return spark.createDataFrame([(a,) for a in ASKED], "prefix array<string>")


@query(LEXICON_SQL + ASKED_SQL + " SELECT array_to_string(a.prefix, '.') AS prefix, p.prefix IS NOT NULL OR len(a.prefix) = 0 AS exists FROM asked a LEFT JOIN prefixes p ON p.prefix = a.prefix")
def q24_prefix_exists(spark, sf_dir):
    return lexicon.prefix_exists(asked_prefixes(spark), trie(spark, sf_dir)).select(F.array_join("prefix", ".").alias("prefix"), "exists")


@query(LEXICON_SQL + ASKED_SQL + """
SELECT array_to_string(a.prefix, '.') AS prefix, p.prefix[p.depth] AS cluster, CAST(p.terminal_freq AS BIGINT) AS terminal_freq, p.subtree_types
FROM asked a JOIN prefixes p ON p.depth > 0 AND p.prefix[1:p.depth - 1] = a.prefix
""")
def q25_completions(spark, sf_dir):
    return lexicon.completions(asked_prefixes(spark), trie(spark, sf_dir)).withColumn("prefix", F.array_join("prefix", "."))


@query(LEXICON_SQL + "SELECT prefix[1] AS cluster, subtree_types FROM prefixes WHERE depth = 1 ORDER BY subtree_types DESC, cluster LIMIT 5")
def q26_top_branches(spark, sf_dir):
    return lexicon.top_branches(trie(spark, sf_dir))


# Grid analysis

PARAMS = list(response.FULL_GRID)
GRID_SQL = """
WITH grid AS (
  SELECT smoothing_k, close_k, window_pad, multi_seg_threshold,
         CAST(row_number() OVER (ORDER BY smoothing_k, close_k, window_pad, multi_seg_threshold) - 1 AS INTEGER) AS ordinal
  FROM (SELECT unnest([1.0, 3.0, 5.0])::DOUBLE AS smoothing_k), (SELECT unnest([2.0, 3.0, 5.0])::DOUBLE AS close_k),
       (SELECT unnest([4.0, 8.0, 12.0, 20.0])::DOUBLE AS window_pad), (SELECT unnest([95.0, 97.0, 99.0])::DOUBLE AS multi_seg_threshold)
)
"""
FACT_SQL = GRID_SQL + """, fact AS (
  SELECT p.p_partkey AS stem, g.*, CAST((p.p_size * 7 + p.p_partkey * 3) % 11 AS DOUBLE) / 4 + abs(g.window_pad - (p.p_partkey % 4) * 6) * 0.25
         + abs(g.smoothing_k - 3) * 0.5 + (99 - g.multi_seg_threshold) * 0.75 + g.close_k * (p.p_size % 3) * 0.125 AS cer
  FROM part p CROSS JOIN grid g
), runs AS (SELECT smoothing_k, close_k, window_pad, multi_seg_threshold, avg(cer) AS mean_cer, count(cer) AS n_valid FROM fact GROUP BY 1, 2, 3, 4)
"""


@query("""
WITH g AS (
  SELECT a AS smoothing_k, b AS close_k, c AS window_pad, d AS multi_seg_threshold,
         CAST(row_number() OVER (ORDER BY a, b, c, d) - 1 AS INTEGER) AS ordinal
  FROM (SELECT DISTINCT CAST(l_linenumber AS DOUBLE) AS a FROM lineitem), (SELECT DISTINCT CAST(n_regionkey AS DOUBLE) AS b FROM nation),
       (SELECT DISTINCT CAST(s_nationkey AS DOUBLE) AS c FROM supplier), (SELECT DISTINCT CAST(length(o_orderpriority) AS DOUBLE) AS d FROM orders)
)
SELECT *, printf('run_%05d', ordinal) AS run_tag FROM g
""")
def q30_grid(spark, sf_dir):
    """The grid of the values that four columns hold; a grid's values are few."""
    columns = [("lineitem", F.col("l_linenumber")), ("nation", F.col("n_regionkey")), ("supplier", F.col("s_nationkey")), ("orders", F.length("o_orderpriority"))]
    held = [table(spark, sf_dir, name).select(c.cast("double").alias("v")).distinct().orderBy("v").collect() for name, c in columns]
    return response.grid_frame(spark, {p: [r.v for r in rows] for p, rows in zip(PARAMS, held, strict=True)})


def fact(spark, sf_dir):
    """Each part under each combination, with a made-up rate in eighths, exact in binary."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("stem"), "p_size")
    both = part.crossJoin(F.broadcast(response.grid_frame(spark, response.FULL_GRID)))  # 108 combinations
    rate = (
        ((F.col("p_size") * 7 + F.col("stem") * 3) % 11).cast("double") / 4 + F.abs(F.col("window_pad") - (F.col("stem") % 4) * 6) * 0.25
        + F.abs(F.col("smoothing_k") - 3) * 0.5 + (99 - F.col("multi_seg_threshold")) * 0.75 + F.col("close_k") * (F.col("p_size") % 3) * 0.125
    )
    return both.select("stem", *PARAMS, "ordinal", rate.alias("cer"))


@query(FACT_SQL + "SELECT stem, count(*) AS n, min(cer) AS least, max(cer) AS most, round(avg(cer), 6) AS mean FROM fact GROUP BY stem")
def q31_fact(spark, sf_dir):
    return fact(spark, sf_dir).groupBy("stem").agg(
        F.count("*").alias("n"), F.min("cer").alias("least"), F.max("cer").alias("most"), six(F.avg("cer")).alias("mean")
    )


def runs(spark, sf_dir):
    return response.ranked_runs(fact(spark, sf_dir), PARAMS)


CORR_SQL = FACT_SQL + ", corr_ AS (" + " UNION ALL ".join(
    f"SELECT '{p}' AS param, coalesce(CAST(round_even(covar_pop({p}, mean_cer) / nullif(stddev_pop({p}) * stddev_pop(mean_cer), 0), 4) AS DOUBLE), 0) + 0.0 AS r FROM runs" for p in PARAMS
) + ")"


@query(CORR_SQL + "SELECT *, CASE WHEN r > 0.3 THEN 'DIRECT' WHEN r < -0.3 THEN 'INVERSE' ELSE 'WEAK' END AS verdict FROM corr_")
def q32_pearson(spark, sf_dir):
    return response.correlations(runs(spark, sf_dir), PARAMS)


def _middle_sql(p):
    return " AND ".join(f"{q} = {response.upper_median(v)}" for q, v in response.FULL_GRID.items() if q != p)


SLOPE_SQL = FACT_SQL + ", pts AS (" + " UNION ALL ".join(
    f"SELECT '{p}' AS param, {p} - {response.upper_median(response.FULL_GRID[p])} AS x, avg(mean_cer) AS y FROM runs WHERE {_middle_sql(p)} GROUP BY 1, 2" for p in PARAMS
) + """), sums AS (
  SELECT param, sum(x) AS s1, sum(x*x) AS s2, sum(x*x*x) AS s3, sum(x*x*x*x) AS s4, sum(y) AS t0, sum(x*y) AS t1, sum(x*x*y) AS t2, count(*) AS n FROM pts GROUP BY 1
), slopes AS (
  SELECT param, (n*(t1*s4 - s3*t2) - t0*(s1*s4 - s3*s2) + s2*(s1*t2 - t1*s2)) / (n*(s2*s4 - s3*s3) - s1*(s1*s4 - s3*s2) + s2*(s1*s3 - s2*s2)) AS slope FROM sums
)"""  # fmt: skip


@query(SLOPE_SQL + "SELECT param, round(slope, 4) AS slope, CASE WHEN slope < 0 THEN 1 ELSE -1 END AS direction, round(abs(slope), 4) AS sensitivity FROM slopes")
def q33_quadratic(spark, sf_dir):
    found = response.quadratic_slopes(runs(spark, sf_dir), response.FULL_GRID)
    return found.withColumn("slope", F.round("slope", 4)).withColumn("sensitivity", F.round("sensitivity", 4))


@query(SLOPE_SQL + "SELECT x.param AS a, y.param AS b, CASE WHEN x.param = y.param THEN 1.0 ELSE coalesce(round(x.slope / nullif(y.slope, 0), 3), 0) + 0.0 END AS ratio FROM slopes x, slopes y")
def q34_ratio_matrix(spark, sf_dir):
    found = response.slope_ratios(response.quadratic_slopes(runs(spark, sf_dir), response.FULL_GRID))
    return found.withColumn("ratio", F.round("ratio", 3) + 0.0)


CENSUS_SQL = FACT_SQL + """, best AS (
  SELECT * FROM (SELECT *, min(cer) OVER (PARTITION BY stem) AS m FROM fact) WHERE cer <= m + 1e-9
), census AS (SELECT smoothing_k, close_k, window_pad, multi_seg_threshold, count(*) AS frequency FROM best GROUP BY 1, 2, 3, 4
), anchor AS (
  SELECT stem, smoothing_k, close_k, window_pad, multi_seg_threshold, cer FROM best JOIN census USING (smoothing_k, close_k, window_pad, multi_seg_threshold)
  QUALIFY row_number() OVER (PARTITION BY stem ORDER BY frequency DESC, multi_seg_threshold DESC, smoothing_k, close_k, window_pad, multi_seg_threshold) = 1
)
"""


@query(CENSUS_SQL + "SELECT * FROM census")
def q35_census(spark, sf_dir):
    return response.census(fact(spark, sf_dir), PARAMS)


def anchors(spark, sf_dir):
    own = fact(spark, sf_dir)
    return response.anchors(own, response.census(own, PARAMS), PARAMS, "multi_seg_threshold")


@query(CENSUS_SQL + "SELECT * FROM anchor")
def q36_anchor(spark, sf_dir):
    return anchors(spark, sf_dir)


@query(CENSUS_SQL + """, moves(ordinal, d_s, d_c, d_w, d_m) AS (
  VALUES (0, 0, 0, 0, 1), (1, 0, 0, 0, -1), (2, 0, 0, 4, 0), (3, 0, 0, -4, 0), (4, 0, 1, 0, 0), (5, 0, -1, 0, 0), (6, 2, 0, 0, 0), (7, -2, 0, 0, 0)
), moved AS (
  SELECT stem, ordinal, smoothing_k + d_s AS s, close_k + d_c AS c, window_pad + d_w AS w, multi_seg_threshold + d_m AS m,
         smoothing_k AS s0, close_k AS c0, window_pad AS w0, multi_seg_threshold AS m0 FROM anchor, moves
), odd AS (
  SELECT stem, ordinal, w0, m0, least(greatest(s, 1), 9) AS s, least(greatest(c, 1), 9) AS c, least(greatest(w, 2), 40) AS w, least(greatest(m, 80), 100) AS m, s0, c0 FROM moved
), legal AS (
  SELECT stem, ordinal, CASE WHEN s % 2 = 1 THEN s ELSE s - 1 END AS smoothing_k, CASE WHEN c % 2 = 1 THEN c ELSE c - 1 END AS close_k, w AS window_pad, m AS multi_seg_threshold,
         CASE WHEN s0 % 2 = 1 THEN s0 ELSE s0 - 1 END AS s0, CASE WHEN c0 % 2 = 1 THEN c0 ELSE c0 - 1 END AS c0, w0, m0 FROM odd
)
SELECT stem, CAST(min(ordinal) AS INTEGER) AS ordinal, smoothing_k, close_k, window_pad, multi_seg_threshold FROM legal
WHERE NOT (smoothing_k = s0 AND close_k = c0 AND window_pad = w0 AND multi_seg_threshold = m0) GROUP BY 1, 3, 4, 5, 6
""")
def q37_clamp(spark, sf_dir):
    return search.probes(anchors(spark, sf_dir).drop("cer"), search.SearchSettings()).drop("note")


def made_up_rate(rows: DataFrame) -> DataFrame:
    """A smooth rate with its least value at a place of each stem's own."""
    off = F.col("stem") % 5
    rate = F.abs(F.col("window_pad") - 9 - off) + F.abs(F.col("multi_seg_threshold") - 96 - off * 0.5) * 2 + F.abs(F.col("smoothing_k") - 5) + F.abs(F.col("close_k") - 3)
    return rows.withColumn("cer", rate.cast("double"))


def _legal_sql(p, value):
    low, high = search.LIMITS[p]
    v = f"least(greatest({value}, {low:.0f}), {high:.0f})"
    if p not in search.ODD:
        return f"round_even({v}, {0 if p == 'window_pad' else 1})"
    n = f"greatest(round_even({v}, 0), 1)"
    return f"CASE WHEN {n} % 2 = 1 THEN {n} WHEN abs({v} - greatest({n} - 1, 1)) <= abs({v} - {n} - 1) THEN greatest({n} - 1, 1) ELSE {n} + 1 END"


def _each(form):
    return ", ".join(form.format(p=p) for p in PARAMS)


# A row for each step of each stem's search: c_ the sweep's centre, b_ the best point, t_ the steps, e_ the probe of ordinal k; n counts a sweep's evaluations.
_MOVES = {(k, p): f"c_{p} {'+-'[k % 2]} t_{p}" for k, p in enumerate(x for x in search.INFLUENCE for _ in "+-")}
_RATE_SQL = "abs({0}window_pad - 9 - stem % 5) + abs({0}multi_seg_threshold - 96 - (stem % 5) * 0.5) * 2 + abs({0}smoothing_k - 5) + abs({0}close_k - 3)"
SEARCH_SQL = f"""
WITH RECURSIVE start AS (
  SELECT p_partkey AS stem, {", ".join(f"CAST({response.upper_median(v)} AS DOUBLE) AS b_{p}" for p, v in response.FULL_GRID.items())} FROM part
), walk AS (
  SELECT stem, -1 AS k, {_each("b_{p}")}, {_each("b_{p} AS c_{p}")}, {_each("b_{p} AS e_{p}")}, {", ".join(f"CAST({v} AS DOUBLE) AS t_{p}" for p, v in search.STEPS.items())},
         {_RATE_SQL.format("b_")} AS cer, CAST(0 AS DOUBLE) AS e_cer, 0 AS hops, 0 AS n, false AS gained, false AS tried, false AS took, true AS live FROM start
  UNION ALL
  SELECT stem, CASE WHEN k = 7 THEN -1 ELSE k END, {_each("b_{p}")}, {_each("CASE WHEN k = 7 THEN b_{p} ELSE c_{p} END")}, {_each("e_{p}")}, {_each("CASE WHEN k = 7 AND NOT gained THEN t_{p} / 2 ELSE t_{p} END")},
         cer, e_cer, hops, CASE WHEN k = 7 THEN 0 ELSE n END, gained AND k < 7, tried, took, k < 7 OR (n > 0 AND hops < 10 AND (gained OR t_multi_seg_threshold / 2 >= {search.SETTLED_STEP}))
  FROM (
    SELECT stem, k, {_each("CASE WHEN took THEN e_{p} ELSE b_{p} END AS b_{p}")}, {_each("c_{p}")}, {_each("e_{p}")}, {_each("t_{p}")}, CASE WHEN took THEN e_cer ELSE cer END AS cer, e_cer,
           hops + CAST(tried AS INTEGER) AS hops, n + CAST(tried AS INTEGER) AS n, gained OR took AS gained, tried, took
    FROM (SELECT *, tried AND cer - e_cer > 0.1 AS took FROM (
      SELECT *, hops < 10 AND ({" OR ".join(f"e_{p} <> c_{p}" for p in PARAMS)}) AS tried, {_RATE_SQL.format("e_")} AS e_cer FROM (
        SELECT stem, k + 1 AS k, {_each("b_{p}")}, {_each("c_{p}")}, {_each("t_{p}")}, cer, hops, n, gained,
               {", ".join(f"CASE k + 1 {' '.join(f'WHEN {k} THEN {_legal_sql(p, move)}' for (k, q), move in _MOVES.items() if q == p)} ELSE {_legal_sql(p, f'c_{p}')} END AS e_{p}" for p in PARAMS)}
        FROM walk WHERE live)))
  )
)
"""


@query(SEARCH_SQL + f"SELECT stem, {_each('b_{p} AS {p}')}, cer AS best_cer, hops FROM walk WHERE NOT live")
def q38_pattern_search(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("stem"))
    start = parts.withColumns({p: F.lit(response.upper_median(v)) for p, v in response.FULL_GRID.items()})
    return search.pattern_search(made_up_rate(start), made_up_rate)


# Recognition


@query("""
WITH l AS (SELECT vec_id, embedding AS e, list_max(embedding) AS m FROM embeddings
), x AS (SELECT vec_id, unnest(range(0, len(e))) AS idx, unnest(list_transform(e, lambda v: exp(CAST(v - m AS DOUBLE)))) AS p FROM l
), s AS (SELECT vec_id, idx, p / sum(p) OVER (PARTITION BY vec_id) AS p FROM x
), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(p, 12) DESC, idx) AS k FROM s)
SELECT vec_id, CAST(k - 1 AS INTEGER) AS k, CAST(idx AS INTEGER) AS idx, round(p * 100, 2) AS conf FROM r WHERE k <= 5
""")
def q40_softmax_top5(spark, sf_dir):
    found = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(recognise.top_classes(F.col("embedding"))).alias("k", "c"))
    return found.select("vec_id", "k", "c.idx", "c.conf")


TURNS_SQL = """
WITH turns AS (SELECT conv_id, CAST(turn AS INTEGER) AS seg_idx, CAST(turn // 3 AS INTEGER) AS word_index, role, text FROM conversations)
"""


def turns(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    return rows.select("conv_id", F.col("turn").cast("int").alias("seg_idx"), F.floor(F.col("turn") / 3).cast("int").alias("word_index"), "role", "text")


@query(TURNS_SQL + """, n AS (
  SELECT *, lag(seg_idx, 1) OVER w AS p1, lag(word_index, 1) OVER w AS w1, lag(seg_idx, 2) OVER w AS p2, lag(word_index, 2) OVER w AS w2,
         lead(seg_idx) OVER w AS n1, lead(word_index) OVER w AS w3 FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY seg_idx))
SELECT conv_id, seg_idx, CASE WHEN w1 = word_index THEN p1 END AS prev_1, CASE WHEN w2 = word_index THEN p2 END AS prev_2, CASE WHEN w3 = word_index THEN n1 END AS next_1 FROM n
""")
def q41_candidates(spark, sf_dir):
    return recognise.candidates(turns(spark, sf_dir), "conv_id", "word_index", "seg_idx").select("conv_id", "seg_idx", "prev_1", "prev_2", "next_1")


# A stand-in variant map over part types; a key without variants has an empty list.
VARIANTS = {"SMALL": ["small ring", "red ring"], "LARGE": ["big ring", "red widget"], "PROMO": [], "ECONOMY": ["blue bolt"], "MEDIUM": [], "STANDARD": ["small widget"]}
EDGES_SQL = "WITH edges(base, compound) AS (VALUES " + ", ".join(f"('{b}', {repr(c) if c else 'NULL'})" for b, cs in VARIANTS.items() for c in (cs or [None])) + ")"
CHECK_SQL = EDGES_SQL + """, free AS (SELECT DISTINCT compound FROM edges WHERE compound IS NOT NULL AND compound NOT IN (SELECT base FROM edges)
), scored AS (
  SELECT p_partkey // 50 AS img, p_partkey % 50 AS seg_idx, p_partkey % 50 // 3 AS word_index, p_type AS base, CAST(p_size * 2 AS DOUBLE) AS base_conf,
         p_name AS merged, CAST(50 + (p_partkey * 13) % 50 AS DOUBLE) AS merged_conf FROM part
), checked AS (
  SELECT s.*, EXISTS (SELECT 1 FROM edges e WHERE e.base = s.base AND e.compound = s.merged) AS is_variant,
         EXISTS (SELECT 1 FROM free f WHERE f.compound = s.merged) AS is_free FROM scored s
), valid AS (SELECT *, is_variant OR (base_conf < 95 AND is_free) AS valid FROM checked)
"""


def scored(spark, sf_dir):
    """Fifty parts an image, so that images grow in number with the table and not in length."""
    key = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        F.floor(key / 50).alias("img"), (key % 50).alias("seg_idx"), F.floor(key % 50 / 3).alias("word_index"), F.col("p_type").alias("base"),
        (F.col("p_size") * 2).cast("double").alias("base_conf"), F.col("p_name").alias("merged"), (50 + (key * 13) % 50).cast("double").alias("merged_conf"),
    )


@query(CHECK_SQL + "SELECT img, seg_idx, base, merged, is_variant, valid FROM valid")
def q42_validate(spark, sf_dir):
    return recognise.validated(scored(spark, sf_dir), variant_edges(spark, VARIANTS)).select("img", "seg_idx", "base", "merged", "is_variant", "valid")


FOLD_SQL = CHECK_SQL.replace("WITH edges", "WITH RECURSIVE edges", 1) + """, ready AS (
  SELECT *, row_number() OVER (PARTITION BY img ORDER BY seg_idx) AS k,
         coalesce(valid AND lead(word_index) OVER (PARTITION BY img ORDER BY seg_idx) = word_index
                  AND merged_conf + CASE WHEN is_variant THEN 2 ELSE 0 END >= base_conf, false) AS can FROM valid
), fold(img, k, can_merge) AS (
  SELECT img, k, can FROM ready WHERE k = 1
  UNION ALL
  SELECT r.img, r.k, CASE WHEN f.can_merge THEN false ELSE r.can END FROM fold f JOIN ready r ON r.img = f.img AND r.k = f.k + 1
), kept AS (
  SELECT r.*, f.can_merge, coalesce(lag(f.can_merge) OVER (PARTITION BY r.img ORDER BY r.k), false) AS eaten FROM ready r JOIN fold f USING (img, k)
), folded AS (
  SELECT img, CAST(seg_idx AS INTEGER) AS idx, CASE WHEN can_merge THEN merged ELSE base END AS char, CASE WHEN can_merge THEN merged_conf ELSE base_conf END AS conf,
         CASE WHEN can_merge THEN 2 ELSE 1 END AS n_segs FROM kept WHERE NOT eaten
)
"""


def folded(spark, sf_dir):
    return recognise.recognised(scored(spark, sf_dir), variant_edges(spark, VARIANTS), "img")


@query(FOLD_SQL + "SELECT * FROM folded")
def q43_merge_fold(spark, sf_dir):
    return folded(spark, sf_dir)


@query(FOLD_SQL + """, shown AS (
  SELECT *, idx // 3 AS word, CASE WHEN lag(idx // 3) OVER (PARTITION BY img ORDER BY idx) <> idx // 3 THEN ' ' ELSE '' END || char AS s FROM folded)
SELECT img, string_agg(s, '' ORDER BY idx) AS text, string_agg(char, '' ORDER BY idx) AS text_no_spaces, CAST(max(word) + 1 AS BIGINT) AS n_words FROM shown GROUP BY img
""")
def q44_assemble(spark, sf_dir):
    chars = folded(spark, sf_dir).withColumn("word", F.floor(F.col("idx") / 3))
    return recognise.assembled(chars, "img", "idx", "char", "word")


# Dataset shell


@query("""
SELECT n.n_name AS font_stem, c.class_id FROM nation n CROSS JOIN (SELECT DISTINCT p_type || '_' || p_brand AS class_id FROM part) c
WHERE NOT EXISTS (SELECT 1 FROM part d JOIN nation m ON m.n_nationkey = d.p_partkey % 25 WHERE d.p_type || '_' || d.p_brand = c.class_id AND m.n_name = n.n_name AND d.p_size > 25)
""")
def q50_work_list(spark, sf_dir):
    fonts = table(spark, sf_dir, "nation").select(F.col("n_name").alias("font_stem"), F.col("n_nationkey").cast("long").alias("k"))
    part = table(spark, sf_dir, "part").withColumn("class_id", F.concat_ws("_", "p_type", "p_brand"))
    done = part.filter("p_size > 25").select("class_id", (F.col("p_partkey") % 25).alias("k")).join(fonts, "k").select("class_id", "font_stem")
    return dataset.work_list(fonts.select("font_stem"), part.select("class_id").distinct(), done)


@query("""
SELECT s_suppkey, CASE WHEN row_number() OVER (PARTITION BY s_nationkey % 3 ORDER BY s_suppkey * 7919 % 104729, s_suppkey)
  <= greatest(1, floor(0.7 * count(*) OVER (PARTITION BY s_nationkey % 3))) THEN 'train' ELSE 'test' END AS split FROM supplier
""")
def q51_tier_split(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").withColumn("tier", F.col("s_nationkey") % 3)
    return dataset.tier_split(rows, "tier", [F.col("s_suppkey") * 7919 % 104729, "s_suppkey"]).select("s_suppkey", "split")


@query("""
SELECT doc_id, CASE WHEN row_number() OVER (PARTITION BY quality, toxic ORDER BY doc_id * 7919 % 104729, doc_id)
  <= floor(0.8 * count(*) OVER (PARTITION BY quality, toxic) + 0.5) THEN 'train' ELSE 'val' END AS split FROM labels
""")
def q52_strat_split(spark, sf_dir):
    rows = table(spark, sf_dir, "labels")
    return dataset.stratified_split(rows, ["quality", "toxic"], [F.col("doc_id") * 7919 % 104729, "doc_id"]).select("doc_id", "split")


@query("""
WITH a AS (SELECT user_id, event_id, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS f, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events
), b AS (SELECT *, sum(f) OVER w AS nf, n - coalesce(max(CASE WHEN f = 0 THEN n END) OVER w, 0) AS run FROM a WINDOW w AS (PARTITION BY user_id ORDER BY event_id)
), c AS (SELECT *, run >= 4 OR (n >= 20 AND nf / n >= 0.25) AS tripped FROM b
), d AS (SELECT *, min(CASE WHEN tripped THEN n END) OVER (PARTITION BY user_id) AS stop FROM c)
SELECT user_id, event_id, CAST(n AS INTEGER) AS n_attempts, CAST(nf AS INTEGER) AS n_failed, CAST(run AS INTEGER) AS run_length, tripped FROM d WHERE stop IS NULL OR n <= stop
""")
def q53_breaker(spark, sf_dir):
    found = dataset.breaker(table(spark, sf_dir, "events"), "user_id", "event_id", F.col("event_type") == "error", max_run=4, max_rate=0.25, min_attempts=20)
    return found.select("user_id", "event_id", "n_attempts", "n_failed", "run_length", "tripped")


@query("""
WITH s AS (SELECT page_id, regexp_replace(regexp_extract(url, '([^/?#]*)([?#].*)?$', 1), '(.)\\.[^.]*$', '\\1') AS tail, replace(split_part(url, '/', 3), '.', '_') AS host FROM pages)
SELECT page_id, tail AS stem, split_part(host, '_', 1) AS class_id, split_part(host, '_', 2) AS tier, array_to_string(string_split(host, '_')[3:], '_') AS font_stem,
       CASE WHEN len(string_split(host, '_')) >= 3 THEN split_part(host, '_', 2) ELSE host END AS class_char,
       concat_ws('_', 'combo', tail, split_part(host, '_', 1)) AS folder FROM s
""".replace("\\\\", "\\"))
def q54_name_parse(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    bare = F.regexp_replace("url", r"[?#].*$", "")
    host = F.translate(F.coalesce(F.try_element_at(F.split("url", "/"), F.lit(3)), F.lit("")), ".", "_")
    class_id, tier, font = T.three_tokens(F.col("host"))
    return pages.select("page_id", T.stem_of(bare).alias("stem"), host.alias("host")).select(
        "page_id", "stem", class_id.alias("class_id"), tier.alias("tier"), font.alias("font_stem"), T.class_char(F.col("host")).alias("class_char"),
        T.class_folder(F.lit("combination"), F.col("stem"), class_id).alias("folder"),
    )


CODES_SQL = (
    "WITH single(cp, s) AS (VALUES " + ", ".join(f"({k}, '{v}')" for k, v in T.LEGACY_SINGLE.items()) + "), multi(cp, s) AS (VALUES "
    + ", ".join(f"({k}, '{v}')" for k, v in T.LEGACY_MULTI.items()) + "), around(cp, b, a) AS (VALUES "
    + ", ".join(f"({k}, '{b}', '{a}')" for k, (b, a) in T.LEGACY_AROUND.items()) + ")"
)
#: From the block's first consonant and first sign on, by part key and size.
CODE_SHAPE = "CASE p_size % 3 WHEN 0 THEN chr(CAST({a} AS INTEGER)) WHEN 1 THEN chr(CAST({a} AS INTEGER)) || chr(CAST({b} AS INTEGER)) ELSE chr(CAST({a} AS INTEGER)) || 'x' || 'y' END"


@query(CODES_SQL + """, g AS (SELECT p_partkey, 3461 + p_partkey % 66 AS a, 3530 + p_partkey % 41 AS b, p_size % 3 AS kind FROM part
), base AS (SELECT g.*, coalesce(s.s, m.s) AS c FROM g LEFT JOIN single s ON s.cp = a LEFT JOIN multi m ON m.cp = a)
SELECT p_partkey, CASE WHEN kind = 0 THEN c WHEN kind = 1 THEN coalesce(r.b || c || r.a, c || CASE WHEN base.b = 3570 THEN 'DD' ELSE s.s END) END AS code
FROM base LEFT JOIN around r ON r.cp = base.b LEFT JOIN single s ON s.cp = base.b
""")
def q55_legacy_encode(spark, sf_dir):
    key = F.col("p_partkey")
    # codepoints as characters by a lookup in the block's string
    block = "".join(chr(c) for c in range(3461, 3461 + 140))
    at = lambda n: F.substring(F.lit(block), n.cast("int"), F.lit(1))
    a, b = at(key % 66 + 1), at(3530 - 3461 + key % 41 + 1)
    kind = F.col("p_size") % 3
    shown = F.when(kind == 0, a).when(kind == 1, F.concat(a, b)).otherwise(F.concat(a, F.lit("xy")))
    return table(spark, sf_dir, "part").select("p_partkey", T.legacy_encode(shown).alias("code"))


@query("""
WITH d AS (SELECT o_orderpriority AS k, o_orderdate AS t, avg(o_totalprice) AS loss FROM orders GROUP BY 1, 2
), r AS (SELECT *, row_number() OVER w AS n, min(loss) OVER w AS best, min(loss) OVER (PARTITION BY k ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior,
         avg(loss) OVER (PARTITION BY k ORDER BY t ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS ma FROM d WINDOW w AS (PARTITION BY k ORDER BY t)
), m AS (SELECT *, CASE WHEN prior IS NULL OR loss < prior THEN n END AS new FROM r)
SELECT k, epoch_us(t) AS t, round(best, 2) AS best, round(ma, 2) AS ma5, CAST(n - max(new) OVER (PARTITION BY k ORDER BY t) AS INTEGER) AS since_best FROM m
""")
def q56_best_so_far(spark, sf_dir):
    daily = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("k"), F.col("o_orderdate").alias("t")).agg(F.avg("o_totalprice").alias("loss"))
    found = dataset.best_so_far(daily, "k", "t", "loss")
    return found.select("k", F.unix_micros(F.col("t").cast("timestamp")).alias("t"), F.round("best", 2).alias("best"), F.round("ma5", 2).alias("ma5"), "since_best")


@query("""
WITH l AS (
  SELECT c_custkey * 4 AS line_no, 'no comma ' || c_name AS v FROM customer
  UNION ALL SELECT c_custkey * 4 + 1, '  ' || c_name || ' , "' || c_mktsegment || '" ' FROM customer
  UNION ALL SELECT c_custkey * 4 + 2, c_name || ',' || c_mktsegment || ', with "more"' FROM customer WHERE c_acctbal > 0
  UNION ALL SELECT c_custkey * 4 + 3, c_mktsegment || ',' FROM customer
  UNION ALL SELECT c_custkey * 4 + 3, '' FROM customer
), p AS (
  SELECT line_no, trim(split_part(trim(v), ',', 1)) AS stem, trim(trim(substring(trim(v), instr(trim(v), ',') + 1)), '"') AS ground_truth FROM l WHERE contains(v, ',')
)
SELECT stem, arg_max(ground_truth, line_no) AS ground_truth FROM p GROUP BY stem
""")
def q57_label_parse(spark, sf_dir):
    """Lines of a label file, several for each customer: without a comma, with spaces and quotes, given anew, without a text, and blank ones."""
    name, segment = F.col("c_name"), F.col("c_mktsegment")
    given = [
        (0, F.concat(F.lit("no comma "), name)), (1, F.concat(F.lit("  "), name, F.lit(' , "'), segment, F.lit('" '))),
        (2, F.when(F.col("c_acctbal") > 0, F.concat(name, F.lit(","), segment, F.lit(', with "more"'))).otherwise("")), (3, F.concat(segment, F.lit(","))), (3, F.lit("")),
    ]
    lines = F.array(*[F.struct(F.lit(n).alias("n"), line.alias("value")) for n, line in given])
    each = table(spark, sf_dir, "customer").select("c_custkey", F.explode(lines).alias("l"))
    return parse_labels(each.select((F.col("c_custkey") * 4 + F.col("l.n")).alias("line_no"), F.col("l.value").alias("value")))


@query("""
SELECT p_partkey, (SELECT arg_min(g, struct_pack(d := abs(p_size - g), k := k)) FROM (VALUES (0, 4.0::DOUBLE), (1, 8.0), (2, 12.0), (3, 20.0)) t(k, g)) AS window_pad,
       CASE WHEN p_size < 15 THEN 'good' WHEN p_size < 40 THEN 'fair' ELSE 'poor' END AS band FROM part
""")
def q58_snap(spark, sf_dir):
    return table(spark, sf_dir, "part").select(
        "p_partkey", T.snap(F.col("p_size"), response.FULL_GRID["window_pad"]).alias("window_pad"),
        T.band(F.col("p_size"), [(15, "good"), (40, "fair")], "poor").alias("band"),
    )
