"""Runs over a folder that fills up: each file is taken once, and a run that breaks off is continued."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.functions.text import stem_of
from scriptorium.sources.sinks import append_rates

FILES = "path string, modificationTime timestamp, length long, content binary"


def run_new_files(
    spark: SparkSession, folder: str, rate: Callable[[DataFrame], DataFrame], table: str, checkpoint: str, run_tag: str, pattern: str = "*.png", files_at_once: int = 1000
) -> int:
    """Rates the files of `folder` that no earlier run with this `checkpoint` has finished, and adds the rows to `table`; returns how many batches there were.

    `rate` maps (path, stem, modificationTime, length, content) to rows with stem and rates. A batch holds up to `files_at_once` files. The file source's log in `checkpoint` says which files
    a batch has, before it is begun, and a second entry that it is done; a batch between the two is begun again with the same files, and replaces what it wrote, as the table is
    kept by run_tag and batch (see `append_rates`). So a job killed at any point leaves no rows twice and none out. `table` and `checkpoint` lie in a file system that
    driver and executors share."""
    done = []

    def add(files: DataFrame, number: int) -> None:
        images = files.withColumn("stem", stem_of(F.col("path")))
        append_rates(rate(images).withColumn("run_tag", F.lit(run_tag)), table, batch=str(number))
        done.append(number)

    source = spark.readStream.format("binaryFile").schema(FILES).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_at_once).load(folder)
    source.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return len(done)
