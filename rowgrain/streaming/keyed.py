"""Insert and upsert by grain for tables that arrive as a stream."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rowgrain.operators import collections as coll

#: Columns that the stored table has beside those of the stream: part of the key space, number of the batch.
PART, BATCH = "_part", "_batch"


def insert_stream(stream: DataFrame, k: Sequence[str], at: str, late: str) -> DataFrame:
    """The first row of each key to arrive; state is kept for ``late`` only."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark(list(k))


def rows_per_key_stream(stream: DataFrame, k: Sequence[str], at: str, late: str, window: str) -> DataFrame:
    """Keys seen more than once within a time window, as windows close."""
    return (
        stream.withWatermark(at, late).groupBy(F.window(at, window), *k)
        .agg(F.count(F.lit(1)).alias("n_rows")).filter(F.col("n_rows") > 1)
    )


def upsert_batches(
    read_current: Callable[[], DataFrame | None], write_next: Callable[[DataFrame, int], None],
    k: Sequence[str], order: Sequence,
) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function: the newest row of each key replaces the stored one.

    Storage is the caller's: ``read_current`` gives the table so far, or None
    at the start, and ``write_next`` stores the next state under the number of
    the batch, so that a repeated batch writes the same thing again.
    """

    def step(batch: DataFrame, number: int) -> None:
        current = read_current()
        write_next(coll.dedup(batch, k, order) if current is None else coll.upsert(current, batch, k, order), number)

    return step


def _exists(spark: SparkSession, path: str) -> bool:
    """On any file system that Spark writes to."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def stored(spark: SparkSession, path: str) -> DataFrame:
    """The table that :func:`upsert_into` keeps under ``path``."""
    return spark.read.parquet(f"{path}/rows").drop(PART)


def upsert_into(path: str, k: Sequence[str], order: Sequence[Column | str], parts: int = 256) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function: the newest row of each key replaces the stored one, in its part of the table only.

    The table lies in ``parts`` folders by a hash of the key, so a batch reads and rewrites the folders of its own keys
    and leaves the others as they are; choose ``parts`` so that a folder is some hundred megabytes.  The driver gets the
    numbers of the touched folders, ``parts`` at most.  New folders are first written beside the table and then put in
    place: a batch that is repeated, also after a crash in between, starts from the finished copy and ends the same.
    A NULL in a key is a value.  ``path`` belongs to one stream with one checkpoint; an empty batch changes nothing.
    """
    table = f"{path}/rows"
    part = F.pmod(F.xxhash64(*k), F.lit(parts)).cast("int")

    def step(batch: DataFrame, number: int) -> None:
        spark, staged = batch.sparkSession, f"{path}/staged-{number % 2}"
        ready = _exists(spark, f"{staged}/_SUCCESS") and not spark.read.parquet(staged).filter(F.col(BATCH) == number).isEmpty()
        if not ready:
            new = coll.dedup(batch, k, order).withColumn(PART, part)
            touched = [r[0] for r in new.select(PART).distinct().collect()]
            if not touched:
                return
            if _exists(spark, table):
                old = spark.read.parquet(table).filter(F.col(PART).isin(touched)).select(*new.columns)
                new = coll.delete(old, new.select(*k), k).unionByName(new)
            new.withColumn(BATCH, F.lit(number)).repartition(len(touched), PART).write.mode("overwrite").parquet(staged)
        rows = spark.read.parquet(staged).drop(BATCH)
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(PART).parquet(table)

    return step
