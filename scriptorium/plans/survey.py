"""Registered queries of the smaller operators: rankings, tables of results, sampling, ids and labels, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from scriptorium.functions import text as T
from scriptorium.operators import dataset, lexicon, metrics, recognise, response, scan, search
from scriptorium.plans import flows
from scriptorium.plans.queries import (
    CENSUS_SQL, CHECK_SQL, CORR_SQL, FACT_SQL, ORACLES, PAIR_SQL, PARAMS, SEARCH_SQL, UNITS, VARIANTS, anchors, asked_prefixes, fact, made_up_rate, query, rated_pairs, runs, scored, six,
)
from scriptorium.session import table
from scriptorium.sources import prefix_index, readers, shared, sinks
from scriptorium.sources.readers import variant_edges

NAMES = ", ".join(PARAMS)


@query(f"WITH found AS ({ORACLES['q40_softmax_top5']}) SELECT f.vec_id, f.k, p.p_name AS class_name, f.conf FROM found f JOIN part p ON p.p_partkey = f.idx")
def q60_class_names(spark, sf_dir):
    """The likeliest classes by name; a class number without a name falls out."""
    found = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(recognise.top_classes(F.col("embedding"))).alias("k", "c"))
    classes = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("idx"), F.col("p_name").alias("class_name"))
    return recognise.named_classes(found.select("vec_id", "k", "c.idx", "c.conf"), classes).select("vec_id", "k", "class_name", "conf")


@query(FACT_SQL + f"""
SELECT {NAMES}, ordinal, mean_cer, CAST(row_number() OVER (ORDER BY mean_cer NULLS LAST, ordinal) AS INTEGER) AS rank
FROM (SELECT {NAMES}, CAST(min(ordinal) AS INTEGER) AS ordinal, round(avg(cer), 9) AS mean_cer FROM fact GROUP BY {NAMES})
""")
def q61_rank_combinations(spark, sf_dir):
    ranked = response.rank_combinations(fact(spark, sf_dir), PARAMS)
    return ranked.select(*PARAMS, "ordinal", F.round("mean_cer", 9).alias("mean_cer"), "rank")


@query(CENSUS_SQL + f"SELECT * FROM census ORDER BY frequency DESC, {NAMES} LIMIT 1")
def q62_top_census(spark, sf_dir):
    return response.top_combination(response.census(fact(spark, sf_dir), PARAMS), PARAMS)


@query(CENSUS_SQL + f"SELECT {NAMES}, min(cer) AS best_cer, count(*) AS n_stems FROM anchor GROUP BY {NAMES}")
def q63_profiles(spark, sf_dir):
    return response.profiles(anchors(spark, sf_dir).withColumnRenamed("cer", "best_cer"), PARAMS)


MIDDLE = {p: response.upper_median(v) for p, v in response.FULL_GRID.items()}
CLIMB_SQL = CENSUS_SQL + f""", climb AS (
  SELECT a.*, f.cer AS start FROM anchor a JOIN fact f ON f.stem = a.stem AND {" AND ".join(f"f.{p} = {v}" for p, v in MIDDLE.items())}
)
"""


def middle_rates(spark, sf_dir):
    """Each stem's rate at the middle of the grid: a search's start."""
    own = fact(spark, sf_dir)
    for p, v in MIDDLE.items():
        own = own.filter(F.col(p) == v)
    return own.select("stem", "cer")


def climbed(spark, sf_dir):
    return anchors(spark, sf_dir).withColumnRenamed("cer", "best_cer").withColumn("hops", F.lit(0))


@query(CLIMB_SQL + f"""
SELECT stem, {NAMES}, round_even(start, 4) AS grid_best_cer, round_even(cer, 4) AS best_cer, round_even(start - cer, 4) AS continuous_gain, 0 AS pipeline_runs FROM climb
""")
def q64_climb_summary(spark, sf_dir):
    return search.climb_summary(climbed(spark, sf_dir), middle_rates(spark, sf_dir))


@query(CLIMB_SQL + "SELECT count(*) AS n_images, count(*) FILTER (start - cer > 0.1) AS n_improved, round(avg(start - cer), 6) AS mean_gain FROM climb")
def q65_improvement(spark, sf_dir):
    found = search.improvement_summary(climbed(spark, sf_dir), middle_rates(spark, sf_dir))
    return found.withColumn("mean_gain", six("mean_gain"))


@query("""
SELECT CAST(l_suppkey AS VARCHAR) AS stem, CAST(l_linenumber AS DOUBLE) AS smoothing_k, CAST(arg_max(l_discount, struct_pack(a := l_orderkey, b := l_partkey, c := l_shipdate, d := l_discount)) AS DOUBLE) AS cer
FROM lineitem GROUP BY 1, 2
""")
def q66_error_table(spark, sf_dir):
    """A table of appended rates, as text; the last of equal keys counts."""
    rows = table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit(" "), F.col("l_suppkey").cast("string")).alias("stem"), F.col("l_linenumber").cast("string").alias("smoothing_k"),
        F.col("l_discount").cast("string").alias("cer"), F.struct("l_orderkey", "l_partkey", "l_shipdate", "l_discount").alias("place"),
    )
    return readers.parse_errors(rows, ["smoothing_k"], "place")


@query(f"WITH r AS ({ORACLES['q34_ratio_matrix']}) SELECT a, " + ", ".join(f"max(ratio) FILTER (b = '{p}') AS {p}" for p in PARAMS) + " FROM r GROUP BY a")
def q67_ratio_pivot(spark, sf_dir):
    slopes = response.quadratic_slopes(runs(spark, sf_dir), response.FULL_GRID)
    wide = response.ratio_matrix(response.slope_ratios(slopes), PARAMS)
    return wide.select("a", *[(F.round(p, 3) + 0.0).alias(p) for p in PARAMS])


@query(r"""
WITH w AS (
  SELECT conv_id, turn, role, list_filter(regexp_split_to_array(trim(coalesce(text, '')), '\s+'), lambda x: x <> '') AS p,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS idx, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations
)
SELECT conv_id AS stem, CAST(idx AS INTEGER) AS idx, role AS char, CAST(turn AS DOUBLE) AS conf,
       """ + ", ".join(f"p[{k + 1}] AS alt{k}_class, CASE WHEN len(p) > {k} THEN CAST({100.0 - k} AS DOUBLE) END AS alt{k}_conf" for k in range(1, 5)) + """,
       CASE WHEN idx = 0 THEN CAST(n AS VARCHAR) END AS ground_truth, CASE WHEN idx = 0 THEN CAST(n AS DOUBLE) END AS cer, CASE WHEN idx = 0 THEN CAST(n + 0.5 AS DOUBLE) END AS wer FROM w
""")
def q68_segment_detail(spark, sf_dir):
    """Conversations as images and turns as recognised units; a turn's words are its predictions, and a detail row shows the alternatives it has room for."""
    guesses = F.transform(T.tokens(F.col("text")), lambda w, k: F.struct(w.alias("class"), (100.0 - k).alias("conf")))
    unit = F.struct("turn", F.col("role").alias("char"), F.col("turn").cast("double").alias("conf"), guesses.alias("predictions"))
    results = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("stem")).agg(F.array_sort(F.collect_list(unit)).alias("units"), F.count("*").alias("n"))
    results = results.select("stem", "units", F.col("n").cast("string").alias("ground_truth"), F.col("n").cast("double").alias("cer"), (F.col("n") + 0.5).cast("double").alias("wer"))
    return sinks.segment_detail(results)


HOP_NOTES = " ".join(f"WHEN {k} THEN 'coord {sign} {p}'" for k, (p, sign) in enumerate((p, sign) for p in search.INFLUENCE for sign in "+-"))


@query(SEARCH_SQL + f"""
SELECT stem, hops AS hop_number, 'climb' AS phase, {", ".join(f"e_{p} AS {p}" for p in PARAMS)}, round_even(e_cer, 4) AS cer, took AS accepted, CASE CASE WHEN k < 0 THEN 7 ELSE k END {HOP_NOTES} END AS note FROM walk WHERE tried
""")
def q69_hop_log(spark, sf_dir):
    """Every evaluation of a search over all parts, with a made-up rate; also tested against a search in plain Python."""
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("stem"))
    start = made_up_rate(parts.withColumns({p: F.lit(v) for p, v in MIDDLE.items()}))
    return search.pattern_search_log(start, made_up_rate)[1]


@query("""
SELECT p_partkey, printf('probe_%06d', p_partkey) AS probe_id, printf('akshara_%03d', p_size) AS unit_id,
       array_to_string(list_transform(string_split(p_name, ''), lambda c: unicode(c)), ' ') AS codepoints FROM part
""")
def q70_ids(spark, sf_dir):
    return table(spark, sf_dir, "part").select(
        "p_partkey", T.padded_id("probe", F.col("p_partkey"), 6).alias("probe_id"), T.padded_id("akshara", F.col("p_size"), 3).alias("unit_id"),
        F.array_join(T.codepoints(F.col("p_name")), " ").alias("codepoints"),
    )


@query("""
SELECT p_partkey, CASE WHEN p_size >= 10 THEN 'variant-map:' || p_brand ELSE 'standalone' || CASE WHEN p_size < 5 THEN '[non-key]' ELSE '' END END
       || printf(' (%.1f%%)', CAST(p_size * 2 AS DOUBLE)) AS chosen_by FROM part
""")
def q71_decision_label(spark, sf_dir):
    kind = F.when(F.col("p_size") >= 10, F.col("p_brand")).otherwise("base")
    return table(spark, sf_dir, "part").select("p_partkey", recognise.decision_label(kind, (F.col("p_size") * 2).cast("double"), F.col("p_size") < 5).alias("chosen_by"))


@query("SELECT l_returnflag AS epoch, round(sum(l_discount * l_quantity) / sum(l_quantity), 6) AS loss, CAST(sum(l_quantity) AS DOUBLE) AS n FROM lineitem GROUP BY 1")
def q72_epoch_loss(spark, sf_dir):
    batches = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("epoch"), F.col("l_discount").cast("double").alias("loss"), F.col("l_quantity").cast("double").alias("n"))
    return dataset.epoch_means(batches, "epoch", ["loss"], "n").withColumn("loss", six("loss"))


@query("SELECT n_nationkey, CASE n_name WHEN 'FRANCE' THEN 'north_?' WHEN 'CHINA' THEN 'east_/' ELSE n_name END AS class_name FROM nation")
def q73_folder_remap(spark, sf_dir):
    nations = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("class_name"))
    return dataset.remapped(nations, "class_name", {"FRANCE": "north_?", "CHINA": "east_/"})


@query("""
WITH g AS (SELECT p_partkey, CASE WHEN p_size > 3 THEN p_brand END AS brand FROM part
), chosen AS (SELECT brand FROM (SELECT DISTINCT brand FROM g WHERE brand IS NOT NULL) ORDER BY length(brand), brand DESC LIMIT 40
), rest AS (SELECT p_partkey FROM g WHERE brand IS NULL ORDER BY p_partkey LIMIT greatest(0, 40 - (SELECT count(*) FROM chosen)))
SELECT p_partkey, brand FROM g JOIN chosen USING (brand) UNION ALL SELECT p_partkey, NULL FROM rest
""")
def q74_font_sample(spark, sf_dir):
    """All rows of 40 groups, and rows without a group for those that are lacking. The sample is the feature."""
    rows = table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_size") > 3, F.col("p_brand")).alias("brand"))
    return dataset.sample_groups(rows, "brand", 40, order=[F.length("brand"), F.desc("brand")], fill="p_partkey")


@query("SELECT o_orderkey FROM orders ORDER BY o_orderkey * 7919 % 104729, o_orderkey LIMIT 100")
def q75_exact_sample(spark, sf_dir):
    """Exactly 100 rows in a drawn order. The sample is the feature."""
    return dataset.sample_rows(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 100, draw=F.col("o_orderkey") * 7919 % 104729)


@query(PAIR_SQL + f""", words AS ({ORACLES['q02_wer_pairs']})
SELECT r.id || '.png' AS image, r.id AS stem, r.pred AS predicted_text, r.ref AS ground_truth, length(r.pred) AS n_units, w.wer, r.cer, r.base AS base_text, r.base_cer
FROM rated r JOIN words w ON w.id = r.id
""")
def q76_image_summary(spark, sf_dir):
    rated = rated_pairs(spark, sf_dir).withColumn("wer", T.wer(F.col("pred"), F.col("ref")))
    rated = rated.select(
        F.concat(F.col("id").cast("string"), F.lit(".png")).alias("image"), F.col("id").alias("stem"), F.col("pred").alias("predicted_text"),
        F.col("ref").alias("ground_truth"), F.length("pred").alias("n_units"), "wer", "cer", F.col("base").alias("base_text"), "base_cer",
    )
    return sinks.image_summary(rated)


@query(CORR_SQL + ", placed AS (SELECT *, CASE param " + " ".join(f"WHEN '{p}' THEN {k}" for k, p in enumerate(PARAMS)) + """ END AS pos FROM corr_)
SELECT param, CAST(row_number() OVER (ORDER BY abs(r) DESC, pos) AS INTEGER) AS place,
       CASE param """ + " ".join(f"WHEN '{p}' THEN {v}" for p, v in search.STEPS.items()) + """ END::DOUBLE * CASE WHEN abs(r) <= 0.1 * max(abs(r)) OVER () AND max(abs(r)) OVER () > 0 THEN 1.5::DOUBLE ELSE 1.0::DOUBLE END AS step FROM placed
""")
def q77_search_settings(spark, sf_dir):
    """A search's settings from the grid's correlations: parameters by influence, and their first steps."""
    known = flows.settings_of(flows.analyse(fact(spark, sf_dir), response.FULL_GRID, "multi_seg_threshold"))
    return spark.createDataFrame([(p, k, known.steps[p]) for k, p in enumerate(known.influence, 1)], "param string, place int, step double")


@query("SELECT n_name, count(*) AS n_suppliers FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE s_nationkey IN (SELECT c_nationkey FROM customer) GROUP BY 1")
def q78_known_images(spark, sf_dir):
    """Images (suppliers) that have a row in the error table (customers of their nation)."""
    images = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("stem"))
    known = metrics.in_error_table(images, table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("stem")))
    names = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("stem"), "n_name")
    return known.join(names, "stem").groupBy("n_name").agg(F.count("*").alias("n_suppliers"))


@query("""
SELECT l_orderkey, l_linenumber, CAST(row_number() OVER (ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey, l_suppkey) AS BIGINT) AS rank FROM lineitem
""")
def q79_rank_all(spark, sf_dir):
    """The rank of each of all lines by price, over ranges of the order and not in one task."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_partkey", "l_suppkey")
    ranked = scan.numbered(lines, F.desc("l_extendedprice"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", name="rank")
    return ranked.select("l_orderkey", "l_linenumber", "rank")


BAG = {"right": 13, "left_1": 17, "left_2": 19, "both_1": 23, "both_2": 29}
TWO_BACK = ("LARGE", "SMALL")


@query(CHECK_SQL.replace("WITH edges", "WITH RECURSIVE edges", 1) + """, ready AS (
  SELECT p_partkey // 50 AS img, p_partkey % 50 AS seg_idx, row_number() OVER w AS k, v.word_index AS word, CASE WHEN p_size % 5 < 2 THEN NULL ELSE v.base END AS base,
         v.base_conf AS conf, v.merged AS char, v.is_variant AS own, v.valid, v.base_conf >= 95 AS locked, CASE WHEN v.is_variant THEN 2 ELSE 0 END AS bonus,
         """ + ", ".join(f"CAST(50 + p_partkey * {m} % 50 AS DOUBLE) AS {kind}" for kind, m in BAG.items()) + """,
         lead(v.word_index) OVER w = v.word_index AS ahead, lag(v.word_index) OVER w = v.word_index AS same_1, lag(v.word_index, 2) OVER w = v.word_index AS same_2
  FROM part JOIN valid v ON v.img = p_partkey // 50 AND v.seg_idx = p_partkey % 50 WINDOW w AS (PARTITION BY v.img ORDER BY v.seg_idx)
), bags AS (
  SELECT *, coalesce(ahead, false) AND NOT locked AND valid AS can_both, coalesce(ahead, false) AND valid AS can_right, NOT locked AND valid AS can_left, base IN ('LARGE', 'SMALL') AS far FROM ready
), picked AS (
  SELECT b.*, r.reach, list_sort(list_filter([
      {'s': -(CASE r.reach WHEN 2 THEN both_2 ELSE both_1 END + bonus), 'o': 0, 'kind': 'both', 'n': 3, 'able': can_both AND r.reach > 0},
      {'s': -("right" + bonus), 'o': 1, 'kind': 'right', 'n': 2, 'able': can_right}, {'s': -(CASE r.reach WHEN 2 THEN left_2 ELSE left_1 END), 'o': 2, 'kind': 'left', 'n': 2, 'able': can_left AND r.reach > 0},
      {'s': -conf, 'o': 3, 'kind': 'base', 'n': 1, 'able': true}], lambda c: c.able))[1] AS best
  FROM bags b, (VALUES (0), (1), (2)) r(reach) WHERE base IS NOT NULL
), fold(img, k, eaten, gaps, kind, reach) AS (
  SELECT img, 0, false, 0, '', 0 FROM bags WHERE k = 1
  UNION ALL
  SELECT b.img, CAST(b.k AS INTEGER), CASE WHEN f.eaten OR b.base IS NULL THEN false ELSE p.best.kind IN ('right', 'both') END,
         CASE WHEN b.base IS NOT NULL OR f.eaten THEN 0 ELSE least(f.gaps + 1, 2) END, CASE WHEN f.eaten OR b.base IS NULL THEN '' ELSE p.best.kind END, coalesce(p.reach, 0)
  FROM fold f JOIN bags b ON b.img = f.img AND b.k = f.k + 1 LEFT JOIN picked p ON p.img = b.img AND p.k = b.k
   AND p.reach = CASE WHEN b.locked OR f.gaps = 0 OR NOT coalesce(b.same_1, false) THEN 0 WHEN b.far AND f.gaps = 2 AND coalesce(b.same_2, false) THEN 2 ELSE 1 END
)
SELECT f.img, CAST(b.seg_idx AS INTEGER) AS idx, CAST(b.seg_idx - CASE WHEN f.kind IN ('left', 'both') THEN f.reach ELSE 0 END AS INTEGER) AS first_idx, CASE f.kind WHEN 'base' THEN b.base ELSE b.char END AS char,
       CASE f.kind WHEN 'base' THEN conf WHEN 'right' THEN "right" WHEN 'left' THEN CASE f.reach WHEN 2 THEN left_2 ELSE left_1 END ELSE CASE f.reach WHEN 2 THEN both_2 ELSE both_1 END END AS conf,
       f.kind, CASE f.kind WHEN 'base' THEN 1 WHEN 'both' THEN 3 ELSE 2 END AS n_segs
FROM fold f JOIN bags b USING (img, k) WHERE f.kind <> ''
""")
def q80_candidate_bag(spark, sf_dir):
    """Units with all their candidates, some segments having none of their own (an empty crop)."""
    key = F.col("p_partkey")
    base = scored(spark, sf_dir).select("img", "seg_idx", "word_index", "base", "base_conf", "merged")
    more = table(spark, sf_dir, "part").select(
        F.floor(key / 50).alias("img"), (key % 50).alias("seg_idx"), (F.col("p_size") % 5 < 2).alias("empty"), *[(50 + key * m % 50).cast("double").alias(f"{kind}_conf") for kind, m in BAG.items()]
    )
    rows = base.join(more, ["img", "seg_idx"]).withColumns({kind: F.col("merged") for kind in BAG}).withColumn("base", F.when(~F.col("empty"), F.col("base")))
    return recognise.merged_segments(rows.drop("merged", "empty"), variant_edges(spark, VARIANTS), "img", TWO_BACK)


@query(ORACLES["q24_prefix_exists"].replace("p.prefix IS NOT NULL OR len(a.prefix) = 0 AS exists", "p.terminal_freq::BIGINT AS terminal_freq, p.subtree_types"))
def q81_stored_walk(spark, sf_dir):
    """Nodes looked up in a stored index, which is built from one half of the documents and grown by the other."""
    docs = table(spark, sf_dir, "documents")
    path = shared.scratch_path(spark, "prefixes")
    half = F.pmod(F.xxhash64("text"), F.lit(2)) == 0
    for part in (docs.filter(F.coalesce(half, F.lit(False))), docs.filter(~F.coalesce(half, F.lit(False)))):
        prefix_index.insert(spark, path, lexicon.segmented(lexicon.corpus_words(part, "text"), UNITS))
    found = prefix_index.walk(prefix_index.open_index(spark, path), asked_prefixes(spark))
    return found.select(F.array_join("prefix", ".").alias("prefix"), "terminal_freq", "subtree_types")
