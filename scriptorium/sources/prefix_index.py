"""A prefix table kept as Parquet that is read by prefix, and grown by more text.

Nodes lie in folders by their first cluster, and in a folder's files sorted by depth and path, in small row groups. So a lookup reads
the folders of the prefixes asked for, and in them the row groups whose range holds one; the predicates are taken from the prefixes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.operators import lexicon
from scriptorium.sources.readers import path_exists
from scriptorium.sources.shared import cut

#: What stands between the clusters of a path; below any character of a cluster, so that a node's children follow each other.
BREAK = "\x1f"
SCHEMA = "prefix array<string>, depth int, terminal_freq long, subtree_types long, path string, parent string, folder string"
NAMES = ["prefix", "depth", "terminal_freq", "subtree_types"]
#: Bytes of a row group, and prefixes that are asked for by predicates; more are joined with the whole index.
GROUP_BYTES, ASKED = 1 << 18, 1000


def placed(nodes: DataFrame) -> DataFrame:
    """Nodes (prefix, depth, ...) with their path, their parent's, and their folder. Clusters hold no BREAK."""
    parent = F.array_join(F.slice("prefix", F.lit(1), F.greatest(F.size("prefix") - 1, F.lit(0))), BREAK)
    return nodes.select(*NAMES, F.array_join("prefix", BREAK).alias("path"), parent.alias("parent"), folder_of(F.col("prefix")).alias("folder"))


def folder_of(prefix: Column) -> Column:
    return F.when(F.size(prefix) > 0, F.concat(F.lit("c"), F.get(prefix, F.lit(0)))).otherwise("root")


def save_index(trie: DataFrame, path: str, folders: bool = False) -> None:
    """Writes a prefix table as an index; with `folders`, only the folders that `trie` has rows of are replaced."""
    spread = placed(trie).repartitionByRange("folder", "depth", "path").sortWithinPartitions("folder", "depth", "path")
    out = spread.write.mode("overwrite").option("parquet.block.size", GROUP_BYTES).option("parquet.page.row.count.limit", 1000)
    out.option("partitionOverwriteMode", "dynamic" if folders else "static").partitionBy("folder").parquet(path)


def open_index(spark: SparkSession, path: str) -> DataFrame:
    """The index as a table (SCHEMA); an index that is missing is empty."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], SCHEMA)
    return spark.read.schema(SCHEMA).parquet(path)


def nodes_at(index: DataFrame, asked: DataFrame, column: str) -> DataFrame:
    """The nodes whose `column` (path, or parent for children) is one of the prefixes of `asked` (prefix), by predicates that reach the files if there are few."""
    keys = asked.select(F.array_join("prefix", BREAK).alias("key"), folder_of(F.col("prefix")).alias("folder"), F.size("prefix").alias("depth")).distinct()
    few = keys.limit(ASKED + 1).collect()
    depth = 1 if column == "parent" else 0
    if len(few) > ASKED:
        return index.join(keys.select(F.col("key").alias(column)), column, "left_semi").filter(F.col("depth") >= depth)
    if not few:
        return index.limit(0)
    found = index.filter(F.col(column).isin([r.key for r in few]) & F.col("depth").isin(sorted({r.depth + depth for r in few})))
    # children of the root lie in all folders
    return found if depth and any(r.folder == "root" for r in few) else found.filter(F.col("folder").isin(sorted({r.folder for r in few})))


def walk(index: DataFrame, asked: DataFrame) -> DataFrame:
    """`lexicon.walk` on a stored index: `asked` (prefix) with its node's terminal_freq and subtree_types, or nulls."""
    return lexicon.walk(asked, nodes_at(index, asked, "path"))


def prefix_exists(index: DataFrame, asked: DataFrame) -> DataFrame:
    """`lexicon.prefix_exists` on a stored index."""
    return lexicon.prefix_exists(asked, nodes_at(index, asked, "path"))


def completions(index: DataFrame, asked: DataFrame) -> DataFrame:
    """`lexicon.completions` on a stored index."""
    return lexicon.completions(asked, nodes_at(index, asked, "parent"))


def insert(spark: SparkSession, path: str, cut_words: DataFrame) -> None:
    """Adds the words of more text (see `lexicon.segmented`) to the index at `path`, which is made if it is missing. Only the folders of these words and the root's are
    rewritten. What they become is kept in the shared folder before the first file is replaced; inserting again counts the text again."""
    if not path_exists(spark, path):
        return save_index(lexicon.prefix_table(cut_words), path)
    index = open_index(spark, path)
    changed = cut(lexicon.grown(index, cut_words))
    touched = [r.folder for r in changed.select(folder_of(F.col("prefix")).alias("folder")).distinct().collect()]  # a folder a first cluster
    if not touched:
        return None
    kept = index.filter(F.col("folder").isin(touched)).select(*NAMES).join(changed.select("prefix"), "prefix", "left_anti")
    return save_index(cut(kept.unionByName(changed.select(*NAMES))), path, folders=True)
