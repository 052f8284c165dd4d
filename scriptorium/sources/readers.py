"""Readers of the files that recognition runs leave and need, with explicit schemas. Bad rows are dropped as stated, never guessed."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.functions.text import first_stem, parse_label_line, stem_of, three_tokens, tokens
from scriptorium.operators.lexicon import prefix_table


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder, asked of the file system that the path belongs to."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def image_files(spark: SparkSession, folder: str, suffixes: tuple[str, ...] = ("png", "jpg", "jpeg"), recursive: bool = False) -> DataFrame:
    """(path, stem, length, modificationTime, content) of image files, by lower-cased suffix; content is only read if it is selected."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(folder)
    wanted = F.regexp_like(F.lower("path"), F.lit(r"\.(" + "|".join(suffixes) + ")$"))
    return files.filter(wanted).select("path", stem_of(F.col("path")).alias("stem"), "length", "modificationTime", "content")


def glyph_files(spark: SparkSession, folder: str) -> DataFrame:
    """PNG files below `folder` but for derived ones, with class_id, tier and font_stem from the name."""
    files = image_files(spark, folder, ("png",), recursive=True)
    files = files.filter(~F.col("stem").contains("_Skeleton") & ~F.col("stem").contains("_Stg"))
    class_id, tier, font = three_tokens(F.col("stem"))
    return files.select("*", class_id.alias("class_id"), tier.alias("tier"), font.alias("font_stem"))


def done_set(files: DataFrame) -> DataFrame:
    """(class_id, font_stem) of the glyphs that exist; the tier is no part of the key."""
    return files.select("class_id", "font_stem").distinct()


def class_folders(spark: SparkSession, folder: str) -> DataFrame:
    """(path, label, class_idx): the folder above a file, and its rank among all folders. There are as many ranks as classes."""
    from pyspark.sql import Window

    files = image_files(spark, folder, recursive=True).select("path", F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("label"))
    ranks = files.select("label").distinct().withColumn("class_idx", F.row_number().over(Window.orderBy("label")) - 1)
    return files.join(ranks, "label")


def file_order() -> F.Column:
    """The order in which rows of several files were written: the file's time, its name, the place of the block in it, and the row's place in the block.
    For a scan's own rows. (How Spark deals files to tasks, which numbers of rows follow, goes by their size.)"""
    return F.struct(
        F.col("_metadata.file_modification_time").alias("time"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("place"),
    )


def parse_labels(lines: DataFrame, value: str = "value", order: str = "line_no") -> DataFrame:
    """(stem, ground_truth) of label lines: the last line of a key counts; lines without a comma and a byte-order mark are dropped."""
    key, text = parse_label_line(F.regexp_replace(F.trim(F.col(value)), "^﻿", ""))
    parsed = lines.select(key.alias("stem"), text.alias("ground_truth"), F.col(order).alias("__order")).filter("stem IS NOT NULL")
    return parsed.groupBy("stem").agg(F.max_by("ground_truth", "__order").alias("ground_truth"))


def labels(spark: SparkSession, path: str) -> DataFrame:
    """(stem, ground_truth) of a label file, or of several, of which the later ones count; see `parse_labels`."""
    lines = spark.read.text(path).withColumn("line_no", file_order())
    return parse_labels(lines)


def baseline(spark: SparkSession, path: str) -> DataFrame:
    """(stem, text) of a baseline CSV (file_name, text); the stem is what stands before the first dot, and the last row counts."""
    rows = spark.read.csv(path, header=True, schema="file_name string, text string", multiLine=True, escape='"')
    rows = rows.withColumn("__order", file_order()).filter("file_name IS NOT NULL")
    return rows.groupBy(first_stem(F.col("file_name")).alias("stem")).agg(F.max_by(F.coalesce("text", F.lit("")), "__order").alias("text"))


def class_list(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema="class_id string, category string, rendered string, unicode_seq string")


def whitelist(spark: SparkSession, path: str) -> DataFrame:
    """Distinct, trimmed, non-empty `rendered` of a tab-separated file."""
    return spark.read.csv(path, header=True, sep="\t").select(F.trim("rendered").alias("rendered")).filter("rendered <> ''").distinct()


def corpus(spark: SparkSession, path: str) -> DataFrame:
    """(word) of each word of the text files."""
    return spark.read.text(path).select(F.explode(tokens(F.col("value"))).alias("word"))


def error_table(spark: SparkSession, path: str, params: list[str]) -> DataFrame:
    """(stem, parameters, cer): blank stems and unreadable parameters are dropped, a missing rate is 100, the last of equal keys counts."""
    return parse_errors(spark.read.csv(path, header=True).withColumn("__order", file_order()), params, "__order")


def parse_errors(rows: DataFrame, params: list[str], order: str) -> DataFrame:
    """As `error_table`, of rows of text with a column that orders them."""
    missing = F.expr("try_cast(cer AS DOUBLE)") if "cer" in rows.columns else F.lit(100.0)
    parsed = rows.select(F.trim("stem").alias("stem"), *[F.expr(f"try_cast({p} AS DOUBLE)").alias(p) for p in params], missing.alias("cer"), order)
    parsed = parsed.filter("stem <> ''").na.drop(subset=[*params, "cer"])
    return parsed.groupBy("stem", *params).agg(F.max_by("cer", order).alias("cer"))


def correlation_table(spark: SparkSession, path: str, params: list[str]) -> DataFrame:
    """(param, r) of the known parameters with a readable r; a missing file gives none, so the default order of influence holds."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], "param string, r double")
    rows = spark.read.csv(path, header=True)
    return rows.select(F.trim("Parameter").alias("param"), F.expr("try_cast(Pearson_r_with_CER AS DOUBLE)").alias("r")).filter(
        F.col("param").isin(params) & F.col("r").isNotNull()
    )


def ratio_table(spark: SparkSession, path: str, params: list[str]) -> DataFrame:
    """(a, b, ratio) of a square matrix file; an unreadable or missing cell is 0, and a missing file gives no rows."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], "a string, b string, ratio double")
    rows = spark.read.csv(path, header=True).filter(F.trim("param").isin(params))
    wide = rows.select(F.trim("param").alias("a"), *[(F.coalesce(F.expr(f"try_cast(`{p}` AS DOUBLE)"), F.lit(0.0)) if p in rows.columns else F.lit(0.0)).alias(p) for p in params])
    return wide.unpivot("a", params, "b", "ratio")


def class_map(spark: SparkSession, path: str) -> DataFrame:
    """(idx, class_name) of a JSON object."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", "map<string,string>")).alias("idx", "class_name"))


def variant_edges(spark: SparkSession, variants: dict[str, list[str]]) -> DataFrame:
    """(base, compound) of a variant map; a base without compounds has one row with null."""
    rows = [(b, c) for b, cs in variants.items() for c in (cs or [None])]
    return spark.createDataFrame(rows, "base string, compound string")


def variant_file(spark: SparkSession, path: str) -> DataFrame:
    """As `variant_edges`, of a JSON object of arrays; a missing file gives no rows, so no variants are tried."""
    if not path_exists(spark, path):
        return variant_edges(spark, {})
    text = spark.read.text(path, wholetext=True)
    pairs = text.select(F.explode(F.from_json("value", "map<string,array<string>>")).alias("base", "compounds"))
    return pairs.select("base", F.explode_outer("compounds").alias("compound"))


def save_trie(trie: DataFrame, path: str) -> None:
    """A prefix table (see `lexicon.prefix_table`) as Parquet by depth, so that a level is read without the others."""
    trie.write.mode("overwrite").partitionBy("depth").parquet(path)


def load_trie(spark: SparkSession, path: str) -> DataFrame:
    """What `save_trie` wrote; a missing one is empty: nothing is found, and only the empty prefix exists."""
    schema = "prefix array<string>, depth int, terminal_freq long, subtree_types long"
    names = ["prefix", "depth", "terminal_freq", "subtree_types"]
    if not path_exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path).select(*names)


def save_trie_json(trie: DataFrame, path: str) -> None:
    """A prefix table as JSON lines, one for each node (path, f), written by the tasks; f is omitted where no word ends."""
    ends = F.when(F.col("terminal_freq") > 0, F.col("terminal_freq"))
    trie.select(F.to_json(F.struct(F.col("prefix").alias("path"), ends.alias("f"))).alias("value")).write.mode("overwrite").text(path)


def load_trie_json(spark: SparkSession, path: str) -> DataFrame:
    """What `save_trie_json` wrote, or one nested object {"tree": node} with nodes {"f": frequency, "c": {cluster: node}}, as a prefix table.
    A nested object is one value by its format, so one task reads it; a missing file gives an empty table."""
    if not path_exists(spark, path):
        return load_trie(spark, path)

    def words(frames):
        for rows in frames:
            for text in rows["value"]:
                record = json.loads(text)
                if "tree" not in record:
                    found = [(record["path"], record["f"])] if record.get("f") else []
                else:
                    found, open_nodes = [], [([], record["tree"])]
                    while open_nodes:
                        prefix, node = open_nodes.pop()
                        if node.get("f", 0) > 0:
                            found.append((prefix, node["f"]))
                        open_nodes += [([*prefix, c], child) for c, child in node.get("c", {}).items()]
                yield pd.DataFrame(found, columns=["clusters", "n"])

    return prefix_table(spark.read.text(path).filter("trim(value) <> ''").mapInPandas(words, "clusters array<string>, n long"))


def font_selection(spark: SparkSession, path: str, fonts: DataFrame | None = None) -> DataFrame:
    """(font_path, font_stem, tier, font_type) of a selection that an earlier run left, to resume from. A missing font_type is taken from
    `fonts` (font_stem, font_type), where it is known; a missing file gives no rows."""
    names = ["font_path", "font_stem", "tier", "font_type"]
    if not path_exists(spark, path):
        return spark.createDataFrame([], ", ".join(f"{c} string" for c in names))
    rows = spark.read.csv(path, header=True)
    rows = rows.select(*[(F.nullif(F.trim(c), F.lit("")) if c in rows.columns else F.lit(None).cast("string")).alias(c) for c in names])
    if fonts is None:
        return rows
    known = fonts.groupBy("font_stem").agg(F.min("font_type").alias("__known"))
    return rows.join(known, "font_stem", "left").withColumn("font_type", F.coalesce("font_type", "__known")).select(*names)


def font_files(spark: SparkSession, folders: dict[str, str]) -> DataFrame:
    """(font_path, font_stem, tier) of the font files of each tier's folder; a missing folder has none."""
    out = spark.createDataFrame([], "font_path string, font_stem string, tier string")
    for tier, folder in folders.items():
        if not path_exists(spark, folder):
            continue
        files = image_files(spark, folder, ("ttf", "otf")).select(F.col("path").alias("font_path"), F.col("stem").alias("font_stem"), F.lit(tier).alias("tier"))
        out = out.unionByName(files)
    return out


def is_unicode_font(cmap):
    """Whether an array of codepoints has one of the Sinhala block."""
    return F.exists(cmap, lambda c: c.between(0x0D80, 0x0DFF))
