"""The event log: one schema, idempotent appends, gapless numbers, pages, retention."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator, Mapping, Sequence
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import StructType

from tidelog.operators import id_index
from tidelog.operators.id_index import exists as _exists
from tidelog.schemas import EVENT_COLUMNS, PAYLOADS


def one_log(*families: DataFrame) -> DataFrame:
    """Event frames of several sources in one schema; a missing or extra column is an error."""
    out = None
    for frame in families:
        missing = [c for c in EVENT_COLUMNS if c not in frame.columns]
        if missing:
            raise ValueError(f"event columns missing: {missing}")
        frame = frame.select(EVENT_COLUMNS)
        out = frame if out is None else out.unionByName(frame)
    if out is None:
        raise ValueError("no event frames")
    return out


#: Where :func:`stable` writes while :func:`passing` holds.
_PASSING: ContextVar[str | None] = ContextVar("passing", default=None)
#: Whether what a job exchanged is deleted when it ends, not when the driver next collects garbage.
_EXCHANGED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _scratch(spark: SparkSession) -> str:
    """A new folder below the checkpoint folder, which all executors share."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not re.fullmatch(r"local(\[[^,]*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(named or "file://" + tempfile.mkdtemp(prefix="tidelog-"))
    return f"{_PASSING.get() or context.getCheckpointDir()}/{uuid.uuid4().hex}"


def stable(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``rows`` written to the checkpoint folder, so that every later read sees the same rows.

    Written once, as packed columns: a checkpoint would run its last stage twice and keep whole rows.
    Reads that ask for values of the columns ``by``, of which there should be few, see only their files."""
    spark, folder = rows.sparkSession, _scratch(rows.sparkSession)
    rows.write.option("compression", "zstd").partitionBy(*by).parquet(folder)
    return spark.read.schema(rows.schema).parquet(folder).select(rows.columns)


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """What :func:`stable` writes meanwhile is deleted at the end: read none of it later. What a job
    exchanges goes when it ends, so run no frame twice."""
    folder, before = _scratch(spark), spark.conf.get(_EXCHANGED, None)
    token = _PASSING.set(folder)
    spark.conf.set(_EXCHANGED, "true")
    try:
        yield
    finally:
        spark.conf.unset(_EXCHANGED) if before is None else spark.conf.set(_EXCHANGED, before)
        _PASSING.reset(token)
        delete(spark, folder)


def delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def positions(rows: DataFrame, order: list[str], name: str = "pos", partitions: int | None = None) -> DataFrame:
    """Gapless numbers from 1 in ``order`` without one task that sees all rows.

    Rows are dealt by range, sorted and numbered where they are, and shifted by the counts of
    the partitions before, a table of one row per partition that goes to all tasks. One exchange in all. ``order``
    must tell rows apart."""
    partitions = partitions or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(partitions, *order).sortWithinPartitions(*order)
    # this id is the partition's number times 2^33 plus the row's place in it
    placed = stable(ranged.withColumn("_id", F.monotonically_increasing_id()))
    placed = placed.withColumn("_part", F.shiftright("_id", 33))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    shift = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    place = F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return placed.join(F.broadcast(shift), "_part").withColumn(name, F.col("_shift") + place).drop("_part", "_shift", "_id")


def counted_before(rows: DataFrame, order: list[str], counts: str, name: str = "rank") -> DataFrame:
    """``rows`` with how many of them, up to and with each in ``order``, have ``counts`` (a boolean column).

    Rows of several kinds may be ranged together, so that those that don't count learn their place
    among those that do: an as-of join in one exchange by range. Each part counts its own, and the
    count that it starts from is carried over from the parts before (a table of one row per part)."""
    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = stable(rows.repartitionByRange(partitions, *order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id()))
    ranged = ranged.withColumn("_part", F.shiftright("_id", 33))
    one = F.when(F.col(counts), 1).otherwise(0)
    parts = ranged.groupBy("_part").agg(F.sum(one).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shift = parts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    inside = F.sum(one).over(Window.partitionBy("_part").orderBy("_id"))
    return ranged.withColumn("_n", inside).join(F.broadcast(shift), "_part").withColumn(name, F.col("_n") + F.col("_shift")).drop("_part", "_shift", "_id", "_n")


def new_events(events: DataFrame, known: DataFrame, order: Sequence[str] = ("occurred_at",)) -> DataFrame:
    """Events whose ``event_id`` isn't in ``known`` (a log, or ids alone), whatever else they hold; of rows
    with the same id the first in ``order`` stays."""
    return _once(events, order).join(known.select("event_id"), "event_id", "left_anti")


def _once(events: DataFrame, order: Sequence[str]) -> DataFrame:
    place = Window.partitionBy("event_id").orderBy(*order)
    return events.withColumn("_place", F.row_number().over(place)).where("_place = 1").drop("_place")


def unseen(events: DataFrame, known: DataFrame, order: Sequence[str]) -> DataFrame:
    """:func:`new_events` of written ``events``: only rows whose id may come twice are exchanged, and none
    where these and the known ids are few."""
    marked = events.withColumn("_mark", F.xxhash64("event_id"))
    often = stable(marked.groupBy("_mark").agg(F.count("*").alias("_n")).where("_n > 1").select("_mark"))
    several = _once(marked.join(often, "_mark", "left_semi"), order)
    rows = marked.join(often, "_mark", "left_anti").unionByName(several).drop("_mark")
    return rows.join(stable(known.select("event_id")), "event_id", "left_anti")


def head(log: DataFrame) -> DataFrame:
    return log.agg(F.coalesce(F.max("seq"), F.lit(0)).cast("long").alias("head"))


def append(events: DataFrame, log: DataFrame, order: list[str], head_: int | None = None) -> DataFrame:
    """The rows to add to the log, numbered from its head on; none for events it has. Where ``head_`` is
    given, numbers go from there and ids of known events are enough for ``log``."""
    numbered = positions(new_events(events, log, order), order, "seq")
    if head_ is not None:
        return numbered.withColumn("seq", F.col("seq") + F.lit(head_))
    top = log.agg(F.coalesce(F.max("seq"), F.lit(0)).cast("long").alias("_head"))
    return numbered.crossJoin(top).withColumn("seq", F.col("seq") + F.col("_head")).drop("_head")


LOG_SCHEMA = "seq long, event_id string, event_type string, schema_version int, aggregate_id string, occurred_at timestamp, content_hash string, payload string, poll_epoch long"
_LOG_COLUMNS = [c.split()[0] for c in LOG_SCHEMA.split(", ")]
#: Numbers of a run that lie in one file after pruning, at most.
ROWS_A_FILE = 1 << 22
#: Of a run's markers the one with the highest version counts; ``head`` is the log's last number then.
MARKER = "attempt string, head long"


def _markers(spark: SparkSession, folder: str) -> DataFrame:
    """run, attempt and head of each committed run."""
    if not _exists(spark, f"{folder}/committed"):
        return spark.createDataFrame([], "run long, attempt string, head long")
    rows = spark.read.schema(MARKER + ", run long, version long").option("basePath", f"{folder}/committed").parquet(f"{folder}/committed")
    return rows.groupBy("run").agg(F.max_by("attempt", "version").alias("attempt"), F.max("head").alias("head"))


def _mark(spark: SparkSession, folder: str, run: int, version: int, attempt: str, head_: int) -> None:
    spark.createDataFrame([(attempt, head_)], MARKER).coalesce(1).write.parquet(f"{folder}/committed/run={run}/version={version}")


def committed(spark: SparkSession, folder: str, run: int) -> bool:
    return not _markers(spark, folder).where(F.col("run") == run).isEmpty()


def commit(events: DataFrame, folder: str, run: int, order: list[str], baseline: DataFrame | None = None, tables: Mapping[str, DataFrame] | None = None) -> None:
    """Append a run's events, with its baseline and other tables of state in the same step. A run that is
    committed already changes nothing.

    An id that the log has, or that comes twice, gives one row: the id index tells which are known
    and reads only the buckets that may hold them. Each attempt writes to folders of its own; the
    marker that names it comes last, so what a crashed attempt left is never read, and a repeated
    run numbers its events anew."""
    spark = events.sparkSession
    markers = _markers(spark, folder)
    attempt = uuid.uuid4().hex
    place = f"run={run}/attempt={attempt}"
    with passing(spark):
        state = markers.agg(F.max(F.when(F.col("run") == run, 1)).alias("done"), F.coalesce(F.max("head"), F.lit(0)).alias("head")).collect()[0]
        if state["done"]:
            return
        events = stable(events)
        known = id_index.known(events.select("event_id"), folder, markers.select("run", "attempt"), stable)
        added = positions(unseen(events, known, order), order, "seq").withColumn("seq", F.col("seq") + F.lit(state["head"]))
        added.select(_LOG_COLUMNS).write.option("compression", "zstd").parquet(f"{folder}/events/{place}")
    added = spark.read.schema(LOG_SCHEMA).parquet(f"{folder}/events/{place}")
    with passing(spark):
        for name, table in (dict(tables or {}) | ({} if baseline is None else {"baseline": baseline})).items():
            table.write.option("compression", "zstd").parquet(f"{folder}/{name}/{place}")
        id_index.add(added.select("event_id"), folder, attempt, run)
        last = added.agg(F.max("seq")).collect()[0][0]
    _mark(spark, folder, run, 0, attempt, last or state["head"])


def compact_index(spark: SparkSession, folder: str) -> None:
    """Merge the id index of all committed runs, so that an append reads one segment in place of many runs."""
    id_index.compact(spark, folder, _markers(spark, folder).select("run", "attempt"))


def _read_runs(spark: SparkSession, folder: str) -> DataFrame:
    if not _exists(spark, f"{folder}/committed"):
        return spark.createDataFrame([], LOG_SCHEMA + ", run long, attempt string")
    rows = spark.read.schema(LOG_SCHEMA + ", run long, attempt string").option("basePath", f"{folder}/events").parquet(f"{folder}/events")
    return rows.join(_markers(spark, folder).select("run", "attempt"), ["run", "attempt"], "left_semi")


def read(spark: SparkSession, folder: str) -> DataFrame:
    """The log of all committed runs; empty before the first."""
    return _read_runs(spark, folder).select(_LOG_COLUMNS)


def read_state(spark: SparkSession, folder: str, name: str, schema: str, runs: Sequence[int] | None = None) -> DataFrame:
    """A table that runs committed beside their events: of the last run that has it, or of ``runs`` with a column run."""
    kept = _markers(spark, folder).select("run", "attempt")
    if not _exists(spark, f"{folder}/{name}"):
        return spark.createDataFrame([], schema + ("" if runs is None else ", run long"))
    rows = spark.read.schema(f"{schema}, run long, attempt string").option("basePath", f"{folder}/{name}").parquet(f"{folder}/{name}")
    if runs is None:
        last = rows.select("run", "attempt").distinct().join(kept, ["run", "attempt"], "left_semi").agg(F.max("run")).collect()[0][0]
        return rows.where(F.col("run") == last).join(kept, ["run", "attempt"], "left_semi").drop("run", "attempt")
    return rows.where(F.col("run").isin(list(runs))).join(kept, ["run", "attempt"], "left_semi").drop("attempt")


def read_baseline(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """The baseline of the last committed run; empty before the first."""
    return read_state(spark, folder, "baseline", schema)


def rewrite_pruned(spark: SparkSession, folder: str, cursors: DataFrame, now: Column, months: int) -> int:
    """Rewrites the runs that hold rows to prune, and only those, in one job; how many rows went. The old
    files are no longer read; the log's head stays, so numbers are never given twice. Ids that went
    may come again."""
    mark = cursors.agg(F.min("last_seq").alias("_mark"))
    judged = _read_runs(spark, folder).crossJoin(F.broadcast(mark)).withColumn("_gone", prunable(F.col("_mark"), now, months))
    counts = judged.where("_gone").groupBy("run").agg(F.count("*").alias("n"))
    rows = spark.read.schema(MARKER + ", run long, version long").option("basePath", f"{folder}/committed").parquet(f"{folder}/committed")
    versions = rows.groupBy("run").agg((F.max("version") + 1).alias("version"), F.max("head").alias("head"))
    touched = stable(counts.join(versions, "run"))
    gone = touched.agg(F.sum("n")).collect()[0][0] or 0
    if not gone:
        return 0
    attempt = uuid.uuid4().hex
    # dealt by run and place, so that a run's rows lie in a few files each
    kept = judged.where("not _gone").join(touched.select("run"), "run", "left_semi").select(*_LOG_COLUMNS, "run", F.lit(attempt).alias("attempt"))
    kept.repartition("run", F.floor(F.col("seq") / ROWS_A_FILE)).write.mode("append").option("compression", "zstd").partitionBy("run", "attempt").parquet(f"{folder}/events")
    id_index.add(kept.select("event_id", "run"), folder, attempt)
    touched.select(F.lit(attempt).alias("attempt"), "head", "run", "version").repartition("run").write.mode("append").partitionBy("run", "version").parquet(f"{folder}/committed")
    return gone


def decoded(log: DataFrame, event_type: str, schema: str) -> DataFrame:
    """Rows of one type with their payload as typed columns: missing fields null, others ignored."""
    rows = log.where(F.col("event_type") == event_type).withColumn("_p", F.from_json("payload", schema))
    return rows.select(*[c for c in log.columns if c != "payload"], "_p.*")


def typed(log: DataFrame, types: Sequence[str]) -> DataFrame:
    """Rows of event types that declare the same fields, with those fields as typed columns.

    A payload is parsed once, to a variant; fields are taken from that. Missing fields, texts of
    another kind and payloads that don't parse give nulls, further fields are left out."""
    (ddl,) = {PAYLOADS[kind] for kind in types}
    fields = StructType.fromDDL(ddl).fields
    got = [F.try_variant_get("_v", f"$.{f.name}", f.dataType.simpleString()).alias(f.name) for f in fields]
    rest = [c for c in log.columns if c not in {"payload", *(f.name for f in fields)}]
    return log.where(F.col("event_type").isin(list(types))).withColumn("_v", F.try_parse_json("payload")).select(*rest, *got)


def typed_views(log: DataFrame) -> dict[str, DataFrame]:
    """:func:`typed` for each event type that is emitted."""
    return {kind: typed(log, [kind]) for kind in PAYLOADS}


def read_after(log: DataFrame, seq: int, limit: int) -> DataFrame:
    return log.where(F.col("seq") > seq).orderBy("seq").limit(limit)


def pages(log: DataFrame, after: int = 0, limit: int = 500, pruned: bool = False) -> DataFrame:
    """Successive pages of at most ``limit`` rows after a number, with the next cursor of each.

    A log that was never pruned has no gaps: the page follows from the number, without a
    shuffle. A pruned one is numbered anew first."""
    rows = log.where(F.col("seq") > after)
    if pruned:
        rows = positions(rows, ["seq"]).withColumn("page", F.floor((F.col("pos") - 1) / limit))
    else:
        rows = rows.withColumn("page", F.floor((F.col("seq") - after - 1) / limit))
    return rows.groupBy("page").agg(F.count("*").alias("n_events"), F.min("seq").alias("first_seq"), F.max("seq").alias("next_seq"))


def prunable(watermark: Column, now: Column, months: int) -> Column:
    """Read by every consumer and old enough; without consumers nothing is."""
    return F.coalesce((F.col("seq") <= watermark) & (F.col("occurred_at") < now - F.expr(f"interval {30 * months} days")), F.lit(False))


def prune(log: DataFrame, cursors: DataFrame, now: Column, months: int) -> tuple[DataFrame, DataFrame]:
    """(rows kept, one row with the number that goes)."""
    mark = cursors.agg(F.min("last_seq").alias("_mark"))
    judged = log.crossJoin(F.broadcast(mark)).withColumn("_gone", prunable(F.col("_mark"), now, months))
    return judged.where("not _gone").drop("_mark", "_gone"), judged.agg(F.count(F.when(F.col("_gone"), 1)).alias("n_pruned"))
