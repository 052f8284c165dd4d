"""A corpus cleaned and packed for training: STAGES in order, each over all that the one before it kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.llm import line_dedup, ngram_join, toxicity
from scriptorium.llm.common import drop_stored, free_name, stored, table
from scriptorium.llm.queries import pack_documents


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents whose toxicity score is under one half. The classifier learns from the given documents and the labels table.

    Null and empty texts, of any length and repeated, have scores like all others; rows without an id are scored and not learned from.
    All columns pass unchanged, whatever their names; an empty table stays empty."""
    model = toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels"))
    return docs.filter(toxicity.scorer(spark, model)(F.col("text")) < 0.5)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: that with the least doc_id (see `ngram_join.keep_one`).

    Texts without words, null ones too, are copies of each other, and of equal rows one stays. All columns pass unchanged; an
    empty table stays empty."""
    return ngram_join.keep_one(docs, n=5, threshold=0.8, recall=0.999)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with what an earlier document or place has cut out of `text`, and n_chars, where there is one, to match.

    Null texts stay null, and n_chars with them; equal rows lose the same; all other columns pass unchanged, whatever their names."""
    spans = free_name("removed_spans", docs)
    found = line_dedup.dedup_units(docs, spans_col=spans)
    chars = F.length("text").cast(docs.schema["n_chars"].dataType) if "n_chars" in docs.columns else None
    return found.select(*[chars.alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, with the sequence and offset where each is packed.

    Null and empty texts are pieces of one id, long texts several pieces, and repeated rows are rows; other columns than doc_id
    and text end here. An empty table gives no pieces."""
    return pack_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_join", drop_near_copies),
    ("line_dedup", drop_repeated_passages),
    ("packing", pack),
]

#: Learning, MinHash and packing are not for SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Each stage is written to the shared folder and read by the next."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs, path = stored(stage(spark, docs, sf_dir), name)
        if before:
            drop_stored(spark, before)
        before = path
    return docs
