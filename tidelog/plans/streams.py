"""Runs streaming jobs over tables that Spark derives: their files are read as a stream until all is done."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tidelog.operators.log import stable

#: Parts a table arrives in, and the order they come in: neighbours change places.
SLICES = 6
ARRIVAL = (1, 0, 3, 2, 5, 4)
_STORE = "spark.sql.streaming.stateStore.providerClass"


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder that all executors share; local only where Spark is."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None and (not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster")):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return f"{(named or 'file://' + tempfile.mkdtemp(prefix='tidelog-')).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@contextmanager
def state_with_timers(spark: SparkSession) -> Iterator[None]:
    """Queries started meanwhile keep their state in RocksDB, which timers and list state need."""
    before = spark.conf.get(_STORE, None)
    spark.conf.set(_STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(_STORE) if before is None else spark.conf.set(_STORE, before)


def out_of_order(rows: DataFrame, seconds: Column, order: tuple[int, ...] = ARRIVAL) -> tuple[list[DataFrame], str]:
    """``rows`` in as many parts by time (``seconds``) as ``order`` has, in that order (by default each part
    comes before the one it should follow), and the lateness that a watermark must allow so that none
    is too late."""
    rows = stable(rows.withColumn("_at", seconds.cast("long")))
    low, high = rows.agg(F.min("_at"), F.max("_at")).collect()[0]
    if low is None:
        return [rows.drop("_at")], "0 seconds"
    width = (high - low) // len(order) + 1
    parts = [rows.where(F.floor((F.col("_at") - low) / width) == k).drop("_at") for k in order]
    return parts, f"{2 * width} seconds"


def in_turn(rows: DataFrame, time: str, size: Column, most: int, least: int = 2) -> list[DataFrame]:
    """``rows`` in parts that follow each other by ``time``, a column: ``least`` of them with about equal sums
    of ``size``, or as many as keep these near ``most``. A time is never divided."""
    sizes = stable(rows.groupBy(time).agg(F.sum(size).alias("_n")))
    width = max(1, min(most, -(-(sizes.agg(F.sum("_n")).collect()[0][0] or 0) // least)))
    before = F.coalesce(F.sum("_n").over(Window.orderBy(time).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = sizes.where(F.col(time).isNotNull()).withColumn("_part", F.floor(before / width)).groupBy("_part").agg(F.min(time), F.max(time)).orderBy("_part").collect()
    return [rows.where(F.col(time).between(low, high)) for _, low, high in parts]


def arriving(parts: list[DataFrame], folder: str) -> DataFrame:
    """A stream that gets ``parts`` one after the other, in several triggers."""
    spark = parts[0].sparkSession
    files = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // SLICES)
    for part in parts:
        part.repartition(files).write.mode("append").parquet(f"{folder}/in")
    return spark.readStream.schema(parts[0].schema).option("maxFilesPerTrigger", files).parquet(f"{folder}/in")


def run(rows: DataFrame | list[DataFrame], job: Callable[[DataFrame], DataFrame], name: str, progress: list | None = None) -> DataFrame:
    """What ``job`` appends for ``rows`` (or for parts that come one after the other), in files of its
    own; ``progress`` gets what the query reported of its batches."""
    parts = rows if isinstance(rows, list) else in_slices(rows)
    spark = parts[0].sparkSession
    folder = shared_folder(spark, name)
    made = job(arriving(parts, folder))
    with state_with_timers(spark):
        query = made.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
    if progress is not None:
        progress += query.recentProgress
    return spark.read.schema(made.schema).parquet(f"{folder}/out")


def in_slices(rows: DataFrame) -> list[DataFrame]:
    """``rows`` dealt to SLICES parts by a hash of all their columns."""
    rows = stable(rows)
    return [rows.where(F.pmod(F.xxhash64(*rows.columns), F.lit(SLICES)) == k) for k in range(SLICES)]


def dropped(progress: list) -> int:
    """Rows that came after their watermark."""
    return sum(operator.numRowsDroppedByWatermark for p in progress for operator in p.stateOperators)


def run_batches(rows: DataFrame, job: Callable[..., Callable[[DataFrame, int], None]], name: str) -> DataFrame:
    """``job(done, parked)`` as foreachBatch: the rows that each gets, with ``parked``. A batch that
    comes again writes over what it wrote before."""
    folder = shared_folder(rows.sparkSession, name)

    def batch(frame: DataFrame, batch_id: int) -> None:
        turn = iter(range(1 << 20))
        put = lambda parked: lambda df: df.select("seq", F.lit(parked).alias("parked")).write.mode("overwrite").parquet(f"{folder}/out/batch={batch_id}/part={next(turn)}")
        job(put(False), put(True))(frame, batch_id)

    arriving(in_slices(rows), folder).writeStream.foreachBatch(batch).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return rows.sparkSession.read.schema("seq long, parked boolean").parquet(f"{folder}/out/*/*")
