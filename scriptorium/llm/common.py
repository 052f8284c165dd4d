"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Odd multipliers of the 64-bit mixing steps.
MIX_A = np.uint64(0x9E3779B97F4A7C15)
MIX_B = np.uint64(0xBF58476D1CE4E5B9)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or, where it is unset on a single machine
    (tests), a new temporary folder that is then used for the whole session. On a cluster the setting is needed."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    context = spark.sparkContext
    if not context.getCheckpointDir():
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints-"))
    return context.getCheckpointDir().rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """`df` computed once and kept in the shared folder; its lineage ends there."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """`df` written as Parquet in the shared folder and read back, with its path (see `drop_stored`)."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def drop_stored(spark: SparkSession, path: str) -> None:
    """Deletes what `stored` wrote, through Hadoop, so that any shared file system will do."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


#: Rows of an Arrow batch where whole texts pass (see `small_batches`).
BATCH = 1000


@contextmanager
def small_batches(spark: SparkSession, rows: int = BATCH) -> Iterator[None]:
    """What runs meanwhile hands at most `rows` rows at once to Python. Spark counts a batch in rows and not in bytes, and its 10,000
    are 34 MB of texts of 3.4 KB, which a task holds several times over, in buffers outside the JVM's heap and in Python. The results are the same."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    given, before = spark.conf.get(name, None), int(spark.conf.get(name))
    spark.conf.set(name, min(rows, before) if before > 0 else rows)
    try:
        yield
    finally:
        spark.conf.unset(name) if given is None else spark.conf.set(name, given)


def text_key(text) -> F.Column:
    """128 bits that stand for a text (MD5); null and empty text have the same key."""
    return F.unhex(F.md5(F.coalesce(text.cast("string"), F.lit("")).cast("binary")))


def free_name(stem: str, df: DataFrame) -> str:
    """A column name that `df` doesn't have."""
    taken, name = {c.lower() for c in df.columns}, f"__{stem}"
    while name in taken:
        name += "_"
    return name


#: A key is hot if it holds more than one part in HOT of all rows, so at most HOT keys are.
HOT = 256


def hot_keys(sized: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., __pieces) of the hot keys among `sized` (keys..., n: rows with the key); HOT rows at most."""
    total = sized.agg(F.sum("n").alias("n")).first().n or 0
    hot = sized.filter(F.col("n") * HOT > total).select(*keys, F.ceil(F.col("n") * HOT / max(total, 1)).cast("int").alias("__pieces"))
    return sized.sparkSession.createDataFrame(hot.collect(), hot.schema)


def spread_join(rows: DataFrame, other: DataFrame, keys: list[str], hot: DataFrame, how: str = "inner", hint: str | None = None) -> DataFrame:
    """`rows` joined to `other`, which has one row for each of the `keys`; the rows of hot keys (see `hot_keys`) are
    dealt over as many pieces as their share asks for, so that none of them fills a task. Other keys meet as in a plain join. `hint` asks for a way of joining, such as "merge"."""
    hot = F.broadcast(hot)  # HOT rows at most
    dealt = F.coalesce(F.pmod(F.monotonically_increasing_id(), F.col("__pieces")), F.lit(0)).cast("int")
    left = rows.join(hot, keys, "left").withColumn("__piece", dealt).drop("__pieces")
    pieces = F.explode(F.sequence(F.lit(0), F.coalesce("__pieces", F.lit(1)) - 1))
    right = other.join(hot, keys, "left").withColumn("__piece", pieces).drop("__pieces")
    return left.join(right.hint(hint) if hint else right, [*keys, "__piece"], how).drop("__piece")


def mix(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """64-bit names of pairs of 64-bit names."""
    out = left * MIX_A
    out ^= out >> np.uint64(29)
    out += right
    out *= MIX_B
    out ^= out >> np.uint64(32)
    return out


def as_int64(names: np.ndarray) -> np.ndarray:
    return names.view(np.int64)
