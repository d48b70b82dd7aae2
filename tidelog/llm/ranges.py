"""Running totals over a total order, without one task that sees all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tidelog.llm.shared import fresh, written


def running_total(rows: DataFrame, order: list, value: str, name: str) -> DataFrame:
    """``rows`` with the sum of ``value`` over all rows before each (``name``, a long) in ``order``.

    Rows are dealt by range and sorted there; each part sums its own rows and starts at the sum of
    the parts before it, a table of one row per part. Rows that tie in ``order`` and are equal in
    all columns may change places. Null values count 0; no rows give no rows.
    """
    number = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    place, part, start, own = fresh(rows, "_place", "_part", "_start", "_own")
    # this id is the part's number times 2^33 plus the row's place in it
    ranged = rows.repartitionByRange(number, *order).sortWithinPartitions(*order).withColumn(place, F.monotonically_increasing_id())
    ranged = written(ranged, "ranged").withColumn(part, F.shiftright(place, 33))
    sums = ranged.groupBy(part).agg(F.coalesce(F.sum(value), F.lit(0)).cast("long").alias(own))
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(part, F.coalesce(F.sum(own).over(before), F.lit(0)).cast("long").alias(start))
    inside = Window.partitionBy(part).orderBy(place).rowsBetween(Window.unboundedPreceding, -1)
    so_far = F.coalesce(F.sum(value).over(inside), F.lit(0)).cast("long")
    return ranged.withColumn(own, so_far).join(starts, part).withColumn(name, F.col(own) + F.col(start)).drop(place, part, own, start)
