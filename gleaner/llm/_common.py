"""Shared plumbing: staged tables, bounded sizes, distributed prefix sums."""

from __future__ import annotations

import atexit
import gc
import math
import shutil
import tempfile
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Words are runs of anything but ASCII space and the five ASCII control blanks.
WORD = r"[^\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"

_own_dirs: dict[str, str] = {}
_staged: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that every executor can reach, from ``spark.checkpoint.dir``.

    Only a local master without that setting gets a temporary folder of its own.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = tempfile.mkdtemp(prefix="gleaner-")
        atexit.register(shutil.rmtree, _own_dirs[app], ignore_errors=True)
    return "file://" + _own_dirs[app]


def stage_path(spark: SparkSession, name: str) -> str:
    """A new place in the shared folder, which ``release`` deletes."""
    path = f"{shared_dir(spark)}/gleaner/{name}-{uuid.uuid4().hex}"
    _staged.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def stage(df: DataFrame, name: str, *, by: list[str] | None = None, reclaim: bool = False, compact: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the lineage ends there.

    ``by`` makes a folder for each value of those columns. ``reclaim`` asks the driver to drop shuffle files
    that nothing refers to any more, and the executors to give unused heap back. ``compact`` shuffles once more, to files of the size that Spark advises instead of
    one a task: each file costs an executor without Hadoop's native library two started processes (chmod, also for the
    checksum), and every later reader a part of a task.
    """
    spark = df.sparkSession
    path = stage_path(spark, name)
    if compact:
        df = df.hint("rebalance")
    df.write.partitionBy(*by or []).parquet(path)
    schema = df.schema
    if reclaim:
        del df
        free_shuffles(spark)
    return spark.read.schema(schema).parquet(path)


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark's context cleaner delete the files of finished, unreferenced shuffles. It hears of them
    when the driver collects garbage, and references to references need another round."""
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.2)
    if not spark.sparkContext._jsc.sc().isLocal():  # else that was the executors' heap, too
        shrink_heaps(spark)


def shrink_heaps(spark: SparkSession) -> None:
    """Let the executors collect garbage, after which they give unused heap back to the system: a heap that grew in one
    stage stays as large otherwise, beside the Python workers of the next. One task for each core; an executor
    that happens to get none keeps its heap."""
    cores = spark.sparkContext.defaultParallelism
    spark.range(0, cores, 1, cores).select(F.expr("reflect('java.lang.System', 'gc')")).write.format("noop").mode("overwrite").save()


def drop_staged(df: DataFrame) -> None:
    """Delete a table that ``stage`` wrote, once nothing reads it any more."""
    spark = df.sparkSession
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        _delete(spark, path)


def staged(spark: SparkSession) -> list[str]:
    """The tables staged by this application and not yet released, oldest first."""
    return _staged.setdefault(spark.sparkContext.applicationId, [])


def release(spark: SparkSession, *, since: int = 0, but_last: bool = False) -> None:
    """Delete the tables staged by this application, indexes among them, once all results that need them are
    written: those after the first ``since``, and with ``but_last`` not the newest."""
    paths = staged(spark)
    gone = paths[since : -1 if but_last else None]
    for path in gone:
        _delete(spark, path)
    paths[:] = [p for p in paths if p not in set(gone)]


def file_system(spark: SparkSession, path: str):
    """Hadoop's file system of ``path``, and ``path`` as it wants it."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def _delete(spark: SparkSession, path: str) -> None:
    files, where = file_system(spark, path)
    files.delete(where, True)


def parts_for(total: float, each: float) -> int:
    """How many parts of at most ``each`` hold ``total``; one at least."""
    return max(1, math.ceil(total / each))


def text_of(df: DataFrame, col: str = "text") -> Column:
    """The text, with null as the empty string."""
    return F.coalesce(df[col].cast("string"), F.lit(""))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, for use inside higher-order functions."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running_total(
    rows: DataFrame, within: list[str], order: list[str], value: Column, spread: str, buckets: int, name: str
) -> DataFrame:
    """Adds ``name``: the sum of ``value`` over the rows before this one within ``within``.

    A group of any size is split over ``buckets`` by the hash of ``spread``, so no task holds a
    whole group. Order: bucket, then ``order``. ``rows`` is read twice; stage it before.
    """
    rows = rows.withColumn("_bucket", F.pmod(F.xxhash64(spread), F.lit(buckets)).cast("int")).withColumn("_value", value)
    before = Window.unboundedPreceding, -1
    base = rows.groupBy(*within, "_bucket").agg(F.sum("_value").alias("_sum"))
    base = base.select(
        *[F.col(c).alias(f"_k_{c}") for c in within],
        F.col("_bucket").alias("_k_bucket"),
        F.coalesce(F.sum("_sum").over(Window.partitionBy(*within).orderBy("_bucket").rowsBetween(*before)), F.lit(0)).alias("_base"),
    )
    local = F.sum("_value").over(Window.partitionBy(*within, "_bucket").orderBy(*order).rowsBetween(*before))
    rows = rows.withColumn("_local", F.coalesce(local, F.lit(0)))
    on = rows["_bucket"] == base["_k_bucket"]
    for c in within:
        on = on & (rows[c] == base[f"_k_{c}"])
    out = rows.join(base, on).withColumn(name, F.col("_base") + F.col("_local"))
    return out.drop("_bucket", "_value", "_local", "_base", "_k_bucket", *[f"_k_{c}" for c in within])
