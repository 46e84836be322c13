"""Helpers that the training-data operators share."""

from __future__ import annotations

import ctypes
import functools
import gc
import tempfile
import uuid
import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_CHECKPOINT = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where the session names none, a local master gets a temporary one; a cluster's executors could not see it, so there it is an error."""
    base = spark.sparkContext.getConf().get(_CHECKPOINT) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {_CHECKPOINT} to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="tallyframe-")
        spark.sparkContext.setCheckpointDir(base)
        base = spark.sparkContext.getCheckpointDir() or base
    return base.rstrip("/")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes df as a Parquet table in the shared folder and reads it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tallyframe/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tallyframe_path = path
    return out


def discard(df: DataFrame) -> None:
    """Deletes the files of a materialise()d table that nothing reads any more."""
    path = getattr(df, "_tallyframe_path", None)
    if path:
        spark = df.sparkSession
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def fold_of(doc_id: Column, folds: int = 5) -> Column:
    """crc32 of the id as text, modulo the number of folds; fold 0 is held out."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def crc(data: bytes) -> int:
    return zlib.crc32(data) & 0xFFFFFFFF


def tasks_for(df: DataFrame, mb_each: float = 16.0, least: int = 8) -> int:
    """A number of tasks in proportion to the optimiser's estimate of the input's size.

    The estimate comes from the sizes of the input files. Without files (rows made on the driver) there is none, and
    the session's number of shuffle partitions is taken.
    """
    spark, plan = df.sparkSession, df._jdf.queryExecution()
    size = int(str(plan.optimizedPlan().stats().sizeInBytes()))
    if size >= int(spark._jsparkSession.sessionState().conf().defaultSizeInBytes()):
        return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return int(min(max(least, size / (mb_each * 1e6)), 200_000))


def small(df: DataFrame, most_rows: int = 1_000_000) -> DataFrame:
    """df, of one or two numbers a row, marked for broadcast if a count shows that it has at most most_rows rows."""
    return F.broadcast(df) if df.count() <= most_rows else df


def fresh(name: str) -> str:
    """A column name that no table has."""
    return f"{name}_{uuid.uuid4().hex}"


def join_by_key(rows: DataFrame, values: DataFrame, keys: list[str], weight: str, how: str = "inner", heavy: int = 10_000) -> DataFrame:
    """rows joined to values on keys, where ``weight`` of values says how many rows may have its key.

    Keys of more than ``heavy`` rows are joined by broadcast (they are fewer than a ``heavy``-th of the rows), so that no
    task gets all rows of one key; the others are shuffled. values has each key once. how: inner or left.
    """
    hot = values.where(F.col(weight) > heavy)
    if hot.isEmpty():
        return rows.join(values, keys, how)
    hot = small(hot)
    rest = rows.join(hot.select(*keys), keys, "left_anti").join(values.where(F.col(weight) <= heavy), keys, how)
    return rows.join(hot, keys, "inner").unionByName(rest)


def hand_back() -> None:
    """Gives freed memory back to the system, since Python workers live on from stage to stage."""
    gc.collect()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def tidied(run):
    """A function of Arrow batches that hands back its memory when it ends."""

    @functools.wraps(run)
    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            hand_back()

    return wrapped


def tidied_group(run):
    """The same for a function of one group's pandas frame."""

    @functools.wraps(run)
    def wrapped(pdf):
        out = run(pdf)
        hand_back()
        return out

    return wrapped


def in_small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Long texts: fewer rows in each Arrow batch than Spark's default, if the session left it at that."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > rows:
        spark.conf.set(key, rows)
