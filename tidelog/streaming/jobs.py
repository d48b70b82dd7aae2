"""The jobs as Structured Streaming queries."""

from __future__ import annotations

import time
from collections.abc import Callable
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, functions as F

from tidelog.operators.consume import payload_matches
from tidelog.schemas import GUARANTEE_WINDOWS, SEEN_SECONDS
from tidelog.streaming.ordered import in_order


def deduplicated(events: DataFrame, seconds: int = SEEN_SECONDS) -> DataFrame:
    """Each event id once within the time to live, by event time."""
    return events.withWatermark("occurred_at", f"{seconds} seconds").dropDuplicatesWithinWatermark(["event_id"])


def rating_deltas(profiles: DataFrame, late: str = "0 seconds") -> DataFrame:
    """Counter changes per user on a stream of (user_id, poll, polled_at, user_like_count, user_dislike_count).

    Polls are taken in the order of ``polled_at`` (then poll), however they arrive: a poll waits in
    state until the watermark, ``late`` behind the newest, has passed it. One that comes later
    than that is left out and counted among the query's rows dropped by the watermark."""
    fields = "poll long, user_like_count int, user_dislike_count int"
    out = "user_id long, poll long, user_like_count int, user_dislike_count int, delta_likes int, delta_dislikes int"
    return in_order(profiles, "user_id", "polled_at", late, fields, out, _rating_steps)


def _rating_steps(user: int, last: tuple | None, rows: list[tuple], until: int) -> tuple[tuple | None, list[tuple], int | None]:
    made = []
    for _, poll, likes, dislikes in rows:
        if last is not None and (likes, dislikes) != last:
            made.append((user, poll, likes, dislikes, likes - last[0], dislikes - last[1]))
        last = (likes, dislikes)
    return last, made, None


def _time(us: int) -> datetime:
    return datetime(1970, 1, 1, tzinfo=timezone.utc) + timedelta(microseconds=us)


def _level(left: int) -> int:
    """How many windows hold an end that is ``left`` microseconds away; 0 once it has passed."""
    return 0 if left <= 0 else sum(left <= span * 1_000_000 for span in GUARANTEE_WINDOWS.values())


#: Names of the windows, the longest first: level 1 is the first.
_LABELS = [label for label, _ in sorted(GUARANTEE_WINDOWS.items(), key=lambda x: -x[1])]


def guarantee_levels(watches: DataFrame, late: str = "0 seconds") -> DataFrame:
    """Fires when a row (item_id, tick, guarantee_end) finds its item in a nearer window than any row
    before, by tick. A row that finds its guarantee expired takes the item off the list; rows later
    than the watermark are left out, so none can bring it back with an earlier tick."""
    rows = watches.withColumn("ends", F.unix_micros("guarantee_end"))
    return in_order(rows, "item_id", "tick", late, "ends long", "item_id long, tick timestamp, label string", _level_steps)


def _level_steps(item: int, state: tuple | None, rows: list[tuple], until: int) -> tuple[tuple | None, list[tuple], int | None]:
    made = []
    for tick, ends in rows:
        most, now = (state[0] if state else 0), _level(ends - tick)
        if now > most:
            made.append((item, _time(tick), _LABELS[now - 1]))
        state = (max(most, now),) if ends > tick else None
    return state, made, None


def guarantee_timers(watches: DataFrame, late: str = "0 seconds") -> DataFrame:
    """``guarantee_expiring`` once for each window of each watched item, by event-time timers.

    ``watches``: item_id, tick, kind, guarantee_end. A ``seed`` (a purchase) puts the item on the list
    afresh; a ``read`` moves its end (null: leaves it), what has fired stays; ``gone`` takes it off.
    A window fires at its own time though no row comes, or at the row that finds it open; of
    several at one row only the nearest. At its end the item leaves state by timer. Rows wait for
    the watermark, ``late`` behind the newest tick; later ones are left out and counted by the query."""
    rows = watches.withColumn("ends", F.unix_micros("guarantee_end"))
    out = "item_id long, tick timestamp, label string, guarantee_end timestamp"
    return in_order(rows, "item_id", "tick", late, "kind string, ends long", out, _timer_steps)


def _timer_steps(item: int, state: tuple | None, rows: list[tuple], until: int) -> tuple[tuple | None, list[tuple], int | None]:
    made = []
    spans = [GUARANTEE_WINDOWS[x] * 1_000_000 for x in _LABELS]

    def fire(at: int, ends: int, level: int) -> None:
        made.append((item, _time(at), _LABELS[level - 1], _time(ends)))

    def passed(state: tuple | None, before: int) -> tuple | None:
        """The watch after all its times before ``before``."""
        while state is not None:
            ends, level = state
            at = ends - spans[level] if level < len(spans) else ends
            if at >= before:
                return state
            if level == len(spans):
                return None
            fire(at, ends, level + 1)
            state = (ends, level + 1)
        return None

    for tick, kind, ends in rows:
        state = passed(state, tick)
        if kind == "seed":
            state = (ends, 0) if ends is not None else None
        elif kind == "gone" or state is None:
            state = None
        elif ends is not None:
            state = (ends, state[1])
        if state is not None:
            now = _level(state[0] - tick)
            if state[0] <= tick:
                state = None
            elif now > state[1]:
                fire(tick, state[0], now)
                state = (state[0], now)
    state = passed(state, until + 1)
    due = None if state is None else state[0] - spans[state[1]] if state[1] < len(spans) else state[0]
    return state, made, due


def subscribed(log: DataFrame, event_types: list[str], filters: dict[str, str], starting_seq: int = 0) -> DataFrame:
    """Matching events of a log stream above a number; the query's checkpoint is the cursor."""
    asked = F.create_map(*[F.lit(x) for pair in filters.items() for x in pair]) if filters else F.create_map().cast("map<string,string>")
    return log.where((F.col("seq") > starting_seq) & F.col("event_type").isin(event_types) & payload_matches(F.col("payload"), asked))


def handled(handler: Callable[[DataFrame], DataFrame], park: Callable[[DataFrame], None], done: Callable[[DataFrame], None], attempts: int = 3, wait: float = 0.0, most_wait: float = 8.0) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: ``handler`` adds a column ``error`` (null: fine). Rows that still fail
    after ``attempts`` tries, with doubled waits between, are parked with their reason, and the
    stream goes on."""

    def run(batch: DataFrame, batch_id: int) -> None:
        held = [batch.persist()]
        try:
            for k in range(attempts):
                if k and wait:
                    time.sleep(min(wait * 2 ** (k - 1), most_wait))
                tried = handler(held[-1]).persist()
                held.append(tried)
                done(tried.where("error is null").drop("error").orderBy("seq"))
                failed = tried.where("error is not null")
                if failed.isEmpty():
                    return
                held.append(failed.drop("error"))
            park(failed.select("seq", "event_id", F.col("error").alias("reason"), "payload"))
        finally:
            for frame in reversed(held):
                frame.unpersist()

    return run
