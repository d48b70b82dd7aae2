"""Keyed state on a stream whose rows arrive out of order."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from itertools import chain
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues
from pyspark.sql.types import BooleanType, DataType, IntegralType, StringType, StructType

#: steps(key, state or None, due rows in order, until) -> (state or None, rows to tell, when to come back or None)
Steps = Callable[[Any, tuple | None, list[tuple], int], tuple[tuple | None, list[tuple], int | None]]

#: Groups that keys are dealt to, by hash. Calls to the state store are made for a group, not for a key, so
#: they don't grow with the keys. A checkpoint keeps the number that it was begun with.
BUCKETS = 1024


class _InOrder(StatefulProcessor):
    """Keeps rows until the watermark passes them, then hands them to ``steps``, key by key and in order.

    State and timer belong to a group of keys. Its rows wait in a list with one pickled element a batch, read only
    once one of them is due; what ``steps`` keeps of its keys is one pickled table. One timer a
    group: the earliest of its waiting rows and of the times ``steps`` asks for. A key without
    waiting rows and without state leaves nothing behind, nor does a group without such keys."""

    def __init__(self, names: list[str], columns: list[str], steps: Steps) -> None:
        self.names, self.columns, self.steps = names, columns, steps

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "rows binary")
        self.kept = handle.getValueState("kept", "keys binary")
        # when the timer goes off (ms)
        self.alarm = handle.getValueState("alarm", "at long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        yield from self._advance([r for frame in rows for r in self._tuples(frame)], timerValues)

    def _tuples(self, frame: pd.DataFrame) -> Iterator[tuple]:
        for nulls, *values in zip(frame[_NULLS].tolist(), *[frame[n].tolist() for n in self.names]):
            yield tuple(values) if not nulls else tuple(None if nulls >> k & 1 else v for k, v in enumerate(values))

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._advance([], timerValues, expiredTimerInfo.getExpiryTimeInMs())

    def _advance(self, new: list[tuple], timers: TimerValues, gone_off: int | None = None) -> Iterator[pd.DataFrame]:
        """Takes ``new`` rows of a group (key, microseconds, *fields) and tells what is due."""
        until = timers.getCurrentWatermarkInMs() * 1000
        alarm = (self.alarm.get() or (None,))[0]
        if (alarm is None or alarm * 1000 > until) and all(r[1] > until for r in new):
            self.waiting.appendValue((pickle.dumps(new),))
            told, times = [], [r[1] for r in new] + ([] if alarm is None else [alarm * 1000])
        else:
            told, times = self._take(alarm is not None, new, until)
        wake = -(-min(times) // 1000) if times else None
        if alarm is not None and alarm not in (wake, gone_off):
            self.handle.deleteTimer(alarm)
        if wake is not None and (wake != alarm or wake == gone_off):
            self.handle.registerTimer(wake)
        if wake != alarm:
            self.alarm.clear() if wake is None else self.alarm.update((wake,))
        if told:
            yield pd.DataFrame(told, columns=self.columns, dtype=object)

    def _take(self, waited: bool, new: list[tuple], until: int) -> tuple[list[tuple], list[int]]:
        """(rows to tell, times to come back at) of a group with rows or keys that are due."""
        before = [r for (part,) in self.waiting.get() for r in pickle.loads(part)] if waited else []
        kept: dict[Any, tuple[int | None, tuple | None]] = pickle.loads((self.kept.get() or (pickle.dumps({}),))[0])
        had = len(kept)
        due: dict[Any, list[tuple]] = {key: [] for key, (back, _) in kept.items() if back is not None and back <= until}
        rest = []
        for r in chain(before, new):
            due.setdefault(r[0], []).append(r[1:]) if r[1] <= until else rest.append(r)
        told = []
        for key, rows in due.items():
            after, made, back = self.steps(key, kept.pop(key, (None, None))[1], in_turn(rows), until)
            told += made
            if after is not None or back is not None:
                kept[key] = (back, after)
        if rest:
            self.waiting.put([(pickle.dumps(rest),)])
        elif before:
            self.waiting.clear()
        if kept:
            self.kept.update((pickle.dumps(kept),))
        elif had:
            self.kept.clear()
        return told, [r[1] for r in rest] + [back for back, _ in kept.values() if back is not None]


#: A column with a bit for each null (frames rename columns with a leading underscore): frames would turn whole numbers with nulls into fractions.
_NULLS = "null_bits"


def _filled(name: str, kind: DataType) -> Column:
    """A column with another value for null."""
    for of, value in ((IntegralType, 0), (BooleanType, False), (StringType, "")):
        if isinstance(kind, of):
            return F.coalesce(name, F.lit(value).cast(kind)).alias(name)
    raise TypeError(f"{name}: no {kind.simpleString()} in ordered rows")


def in_turn(rows: list[tuple]) -> list[tuple]:
    """``rows`` sorted; nulls come first."""
    try:
        return sorted(rows)
    except TypeError:  # a null met a value
        return sorted(rows, key=lambda r: tuple((v is not None, v) for v in r))


def in_order(rows: DataFrame, key: str, time: str, late: str, fields: str, out: str, steps: Steps, buckets: int = BUCKETS) -> DataFrame:
    """What ``steps`` makes of a stream's rows, for each ``key`` in the order of ``time``.

    ``steps`` gets rows of (microseconds, *``fields``) up to the watermark, each row once, equal times
    by the fields; it also runs when the time that it last asked for has come. Rows at or below the
    watermark of the batch before, ``late`` behind the newest time, are dropped by the query
    and counted in its progress. Keys are dealt to ``buckets`` groups, and one group's waiting rows and states
    are in a task's memory at a time. Times beyond the year 2259
    don't move the watermark further. Needs a state store with timers (RocksDB)."""
    rows = rows.select(key, time, F.unix_micros(time).alias("us"), *StructType.fromDDL(fields).names)
    names = [c for c in rows.columns if c != time]
    nulls = F.lit(0).cast("long")
    for k, name in enumerate(names):
        nulls += F.when(F.col(name).isNull(), 1 << k).otherwise(0)
    bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("long").alias("key_group")
    # frames hold times of these years only; ``us`` is the row's own time
    first, last = F.lit("1700-01-01 00:00:00 UTC").cast("timestamp"), F.lit("2260-01-01 00:00:00 UTC").cast("timestamp")
    at = F.when(F.col(time) < first, first).when(F.col(time) > last, last).otherwise(F.col(time)).alias(time)
    rows = rows.select(bucket, at, nulls.alias(_NULLS), *[_filled(n, rows.schema[n].dataType) for n in names])
    processor = _InOrder(names, StructType.fromDDL(out).names, steps)
    return rows.withWatermark(time, late).groupBy("key_group").transformWithStateInPandas(processor, out, "append", "eventTime")
