"""A lexicon as a prefix table: words of unit clusters, their frequencies, and subtree counts by prefix."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.functions.text import longest_match, tokens


def corpus_words(lines: DataFrame, column: str = "value") -> DataFrame:
    """(word) of each word of the text in `column`."""
    return lines.select(F.explode(tokens(F.col(column))).alias("word"))


def segmented(words: DataFrame, units: list[str]) -> DataFrame:
    """(word, n, clusters) of each distinct word: how often it stands, and its clusters, or null where units don't cover it.

    Words are counted before they are cut, so each distinct one is cut and not each token; counting combines on the map side.
    """
    counted = words.groupBy("word").agg(F.count("*").alias("n"))
    # a condition on n keeps a filter on clusters above the count; below it, every token would be cut
    return counted.withColumn("clusters", F.when(F.col("n") > 0, longest_match(F.col("word"), units)))


def corpus_counts(cut: DataFrame) -> DataFrame:
    """One row: tokens, and of these the valid and discarded, and distinct valid words."""
    ok = F.col("clusters").isNotNull()
    return cut.agg(
        F.sum("n").alias("total"),
        F.coalesce(F.sum(F.when(ok, F.col("n"))), F.lit(0)).alias("valid"),
        F.coalesce(F.sum(F.when(~ok, F.col("n"))), F.lit(0)).alias("discarded"),
        F.count_if(ok).alias("unique_valid"),
    )


def prefix_table(cut: DataFrame) -> DataFrame:
    """(prefix array, depth, terminal_freq, subtree_types) of every prefix of the valid words, the empty one included."""
    valid = cut.filter("clusters IS NOT NULL")
    each = valid.select("n", "clusters", F.explode(F.sequence(F.lit(0), F.size("clusters"))).alias("depth")).select(
        F.slice("clusters", F.lit(1), F.col("depth")).alias("prefix"), "depth", F.when(F.col("depth") == F.size("clusters"), F.col("n")).alias("own")
    )
    return each.groupBy("prefix", "depth").agg(
        F.coalesce(F.sum("own"), F.lit(0)).alias("terminal_freq"), F.count("*").alias("subtree_types")
    )


def search(words: DataFrame, cut: DataFrame) -> DataFrame:
    """`words` with `freq`: how often the corpus has the word, 0 if never or if units don't cover it."""
    known = cut.filter("clusters IS NOT NULL").select("word", F.col("n").alias("freq"))
    return words.join(known, "word", "left").withColumn("freq", F.coalesce("freq", F.lit(0)))


def walk(prefixes: DataFrame, trie: DataFrame) -> DataFrame:
    """`prefixes` (prefix array) with the node's terminal_freq and subtree_types; nulls where there is no such node."""
    return prefixes.join(trie.select("prefix", "terminal_freq", "subtree_types"), "prefix", "left")


def prefix_exists(prefixes: DataFrame, trie: DataFrame) -> DataFrame:
    """`prefixes` (prefix array) with `exists`: whether some word starts with these whole clusters. True for the empty prefix."""
    found = trie.select("prefix", F.lit(True).alias("found"))
    return prefixes.join(found, "prefix", "left").withColumn("exists", F.coalesce("found", F.size("prefix") == 0)).drop("found")


def completions(prefixes: DataFrame, trie: DataFrame) -> DataFrame:
    """(prefix, cluster, terminal_freq, subtree_types): the clusters that can follow each of `prefixes`."""
    children = trie.filter("depth > 0").select(
        F.expr("slice(prefix, 1, depth - 1)").alias("prefix"), F.element_at("prefix", -1).alias("cluster"), "terminal_freq", "subtree_types"
    )
    return prefixes.join(children, "prefix")


def top_branches(trie: DataFrame, n: int = 5) -> DataFrame:
    """The root's children with most words below, by cluster where equal."""
    first = trie.filter("depth = 1").select(F.element_at("prefix", 1).alias("cluster"), "subtree_types")
    return first.orderBy(F.desc("subtree_types"), "cluster").limit(n)


def grown(trie: DataFrame, cut: DataFrame) -> DataFrame:
    """The rows of `trie` (a prefix table) that more text changes, as they are then. `cut` are the words of that text (see `segmented`).

    Frequencies are added at the words' nodes. A word that the trie already ends counts in no subtree again, so types are counted for new words alone. Only
    nodes on the way to a word are returned; all others stay as they are."""
    names = ["prefix", "depth", "terminal_freq", "subtree_types"]
    valid = cut.filter("clusters IS NOT NULL").groupBy("clusters").agg(F.sum("n").alias("n"))
    ends = trie.filter("terminal_freq > 0").select(F.col("prefix").alias("clusters"), F.lit(0).alias("__new"))
    words = valid.join(ends, "clusters", "left").withColumn("__new", F.coalesce("__new", F.lit(1)))
    each = words.select("n", "clusters", "__new", F.explode(F.sequence(F.lit(0), F.size("clusters"))).alias("depth"))
    own = F.when(F.col("depth") == F.size("clusters"), F.col("n")).otherwise(0)
    more = each.groupBy(F.slice("clusters", F.lit(1), F.col("depth")).alias("prefix"), "depth").agg(F.sum(own).alias("__freq"), F.sum("__new").alias("__types"))
    found = more.join(trie.select(*names), ["prefix", "depth"], "left")
    both = lambda old, new: (F.coalesce(old, F.lit(0)) + F.col(new)).cast("long").alias(old)
    return found.select("prefix", "depth", both("terminal_freq", "__freq"), both("subtree_types", "__types"))
