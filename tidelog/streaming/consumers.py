"""Consumers that read the log as it grows: their cursors are a versioned table that only one writer advances."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidelog.operators import consume, log
from tidelog.operators.id_index import exists

CURSORS = "consumer_name string, last_seq long"


class Lost(Exception):
    """Another writer has made this version of the cursors."""


def _claim(spark: SparkSession, path: str, text: str) -> bool:
    """Put ``text`` at ``path`` in one step; False if something is there already."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    hadoop = jvm.org.apache.hadoop.fs
    target, draft = hadoop.Path(path), hadoop.Path(f"{path.rsplit('/', 1)[0]}/_{uuid.uuid4().hex}")
    context = hadoop.FileContext.getFileContext(target.toUri(), conf)
    out = draft.getFileSystem(conf).create(draft, False)
    out.write(bytearray(text.encode()))
    out.close()
    never = spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$Rename"), 1)
    never[0] = getattr(hadoop, "Options$Rename").NONE
    try:
        context.rename(draft, target, never)
    except Exception as error:  # the file system tells it in its own classes
        context.delete(draft, False)
        if "FileAlreadyExists" in str(error):
            return False
        raise
    return True


def _versions(spark: SparkSession, folder: str) -> tuple[int, str | None]:
    """The newest version of the cursors and its attempt; 0 before the first."""
    if not exists(spark, f"{folder}/versions"):
        return 0, None
    newest = spark.read.text(f"{folder}/versions").select(F.split("value", " ").alias("v")).select(F.col("v")[0].cast("long").alias("n"), F.col("v")[1].alias("attempt")).agg(F.max("n"), F.max_by("attempt", "n")).collect()[0]
    return newest[0] or 0, newest[1]


def read_cursors(spark: SparkSession, folder: str) -> tuple[int, DataFrame]:
    """(version, cursors); a consumer without a row stands at 0."""
    version, attempt = _versions(spark, folder)
    if attempt is None:
        return 0, spark.createDataFrame([], CURSORS)
    return version, spark.read.schema(CURSORS).parquet(f"{folder}/cursors/{attempt}")


def advance(spark: SparkSession, folder: str, version: int, cursors: DataFrame, deliveries: DataFrame | None = None) -> int:
    """Make ``cursors`` the version after ``version``, with what was delivered on the way; the new version.

    Both are written first under an attempt of their own; then one file, which can be made once only,
    names the attempt. If another writer has made the version, nothing changes and Lost is raised."""
    attempt = uuid.uuid4().hex
    if deliveries is not None:
        deliveries.write.parquet(f"{folder}/deliveries/attempt={attempt}")
    cursors.select("consumer_name", "last_seq").write.parquet(f"{folder}/cursors/{attempt}")
    if not _claim(spark, f"{folder}/versions/{version + 1:020d}", f"{version + 1} {attempt}\n"):
        raise Lost(f"version {version + 1} of the cursors in {folder} is another writer's")
    return version + 1


def delivered(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """What was delivered under versions that count, with the version."""
    if not exists(spark, f"{folder}/versions"):
        return spark.createDataFrame([], f"{schema}, version long")
    rows = spark.read.schema(f"{schema}, attempt string").option("basePath", f"{folder}/deliveries").parquet(f"{folder}/deliveries")
    named = spark.read.text(f"{folder}/versions").select(F.split("value", " ").alias("v")).select(F.col("v")[0].cast("long").alias("version"), F.col("v")[1].alias("attempt"))
    return rows.join(named, "attempt").drop("attempt")


#: A log's markers: a run that is committed, and the log's last number then.
MARKERS = "attempt string, head long, run long, version long"
DELIVERY = "consumer_name string, seq long, event_id string, event_type string, payload string"


def new_heads(spark: SparkSession, log_folder: str, markers: int = 1) -> DataFrame:
    """A stream of a log's markers, as its runs are committed. Only they wake consumers: files of an
    attempt that died would be seen by a stream of the events themselves."""
    return spark.readStream.schema(MARKERS).option("basePath", f"{log_folder}/committed").option("maxFilesPerTrigger", markers).parquet(f"{log_folder}/committed")


def catch_up(log_folder: str, folder: str, subscriptions: Callable[[], DataFrame], handle: Callable[[DataFrame], DataFrame] | None = None) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function on :func:`new_heads`: every consumer's matching events above its cursor, up to
    the head that the batch tells of, in order of seq.

    ``subscriptions`` gives the consumers of the moment. ``handle`` gets the deliveries (DELIVERY) and gives
    those that were made; their rows lie in order of consumer and seq. The cursors of all active
    consumers move to the head with them in one step, so a batch that died before leaves nothing, one
    that comes again finds its cursors at the head, and of two writers one is told that it lost."""

    def run(heads: DataFrame, batch_id: int) -> None:
        spark = heads.sparkSession
        head = heads.agg(F.max("head")).collect()[0][0]
        version, cursors = read_cursors(spark, folder)
        if head is None:
            return
        asked = subscriptions()
        rows = log.read(spark, log_folder).where(F.col("seq") <= head)
        with log.passing(spark):
            # written before it is ranged, which reads it twice
            due = log.stable(consume.catch_up(rows, asked, cursors).select([c.split()[0] for c in DELIVERY.split(", ")]))
            due = due.repartitionByRange("consumer_name", "seq").sortWithinPartitions("consumer_name", "seq")
            moved = asked.where("active").select("consumer_name", F.lit(head).cast("long").alias("last_seq"))
            after = cursors.unionByName(moved).groupBy("consumer_name").agg(F.max("last_seq").alias("last_seq"))
            advance(spark, folder, version, after, due if handle is None else handle(due))

    return run
