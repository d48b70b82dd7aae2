"""Streams over several micro-batches, out of order, with late rows."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidelog.operators import feeds
from tidelog.plans import streams
from tidelog.schemas import GUARANTEE_WINDOWS
from tidelog.streaming import jobs, ordered

DAY = datetime(2026, 1, 10)
HOUR = timedelta(hours=1)
FAR = datetime(2030, 1, 1)
PROFILE = "user_id long, poll long, polled_at timestamp, user_like_count int, user_dislike_count int"
WATCH = "item_id long, tick timestamp, kind string, guarantee_end timestamp"


def parts(spark, schema, *batches):
    """One file for each batch, so that a trigger reads one."""
    return [spark.createDataFrame(list(b), schema).coalesce(1) for b in batches]


@pytest.fixture(autouse=True)
def one_file_a_trigger(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def rows_left(progress):
    """Rows in state at the end, less the two (itself and its alarm) of the last row, which waits on."""
    return sum(op.numRowsTotal for op in progress[-1].stateOperators) - 2


def profile(user, poll, likes, dislikes=0):
    return (user, poll, DAY + poll * HOUR, likes, dislikes)


def test_ratings_come_in_any_order(spark):
    """Polls 1 and 3, then 2, then 4: each step tells +10, as in the batch rule; a repeated row tells nothing."""
    rows = [profile(1, 1, 10), profile(1, 3, 30), profile(1, 2, 20), profile(1, 4, 40), profile(2, 2, 5, 1), profile(2, 1, 5, 1), profile(2, 3, 5, 2), profile(1, 2, 20)]
    progress = []
    found = streams.run(parts(spark, PROFILE, rows[:2], [rows[2], rows[4]], [rows[3], rows[7]], [rows[5], rows[6]], [(9, 1, FAR, 0, 0)]), lambda r: jobs.rating_deltas(r, "5 hours"), "t", progress)
    got = sorted((r.user_id, r.poll, r.delta_likes, r.delta_dislikes) for r in found.collect())
    batch = feeds.rating_changes(spark.createDataFrame(rows[:7], PROFILE)).collect()
    assert got == sorted((r.user_id, r.poll, r.delta_likes, r.delta_dislikes) for r in batch) == [(1, 2, 10, 0), (1, 3, 10, 0), (1, 4, 10, 0), (2, 3, 0, 1)]
    assert streams.dropped(progress) == 0 and len([p for p in progress if p.numInputRows]) == 5


def test_polls_later_than_the_watermark_are_counted(spark):
    progress = []
    batches = [[profile(1, 1, 10), profile(1, 20, 30)], [profile(1, 21, 31)], [profile(1, 2, 99), profile(1, 3, 98)], [(9, 1, FAR, 0, 0)]]
    found = streams.run(parts(spark, PROFILE, *batches), lambda r: jobs.rating_deltas(r, "5 hours"), "t", progress)
    assert sorted((r.poll, r.delta_likes) for r in found.collect()) == [(20, 20), (21, 1)]
    assert streams.dropped(progress) == 2


def test_an_expired_guarantee_is_not_told_again(spark):
    """Ticks 20 and 5 hours before the end, one hour after it, then 3 hours before it: no second 6h."""
    tick = lambda h: (1, DAY + h * HOUR, DAY)
    schema = "item_id long, tick timestamp, guarantee_end timestamp"
    for late, drops in (("1 day", 0), ("10 minutes", 1)):
        progress = []
        found = streams.run(parts(spark, schema, [tick(-20)], [tick(-5)], [tick(1)], [(2, DAY + HOUR, DAY)], [tick(-3)], [(9, FAR, DAY)]), lambda r: jobs.guarantee_levels(r, late), "t", progress)
        assert sorted((r.item_id, r.tick, r.label) for r in found.collect()) == [(1, DAY - 20 * HOUR, "24h"), (1, DAY - 5 * HOUR, "6h")]
        assert streams.dropped(progress) == drops and rows_left(progress) == 0


def watch(item, hours, kind="seed", end=None):
    return (item, DAY + hours * HOUR, kind, None if end is None else DAY + end * HOUR)


def test_guarantees_fire_by_timer(spark):
    """Item 1: three windows, no row but the purchase. 2: bought 3 hours before its end. 3: its end moves after
    24h has fired. 4: gone. 5: bought again after its end. 6: its end passes before it is bought."""
    progress = []
    batches = [
        [watch(1, 0, end=48), watch(3, 0, end=30), watch(4, 0, end=48), watch(6, 5, end=4)],
        [watch(2, 10, end=13), watch(3, 10, "read", 60), watch(5, 1, end=3)],
        [watch(4, 30, "gone"), watch(5, 20, end=22)],
        [watch(8, 40, "read", 50), watch(3, 41, "read")],
        [watch(4, 2, "seed", 90)],
        [(99, FAR, "read", None)],
    ]
    found = streams.run(parts(spark, WATCH, *batches), lambda r: jobs.guarantee_timers(r, "12 hours"), "t", progress)
    got = sorted((r.item_id, (r.tick - DAY) / HOUR, r.label, (r.guarantee_end - DAY) / HOUR) for r in found.collect())
    assert got == [
        (1, 24, "24h", 48), (1, 42, "6h", 48), (1, 47, "1h", 48), (2, 10, "6h", 13), (2, 12, "1h", 13), (3, 6, "24h", 30), (3, 54, "6h", 60), (3, 59, "1h", 60),
        (4, 24, "24h", 48), (5, 1, "6h", 3), (5, 2, "1h", 3), (5, 20, "6h", 22), (5, 21, "1h", 22),
    ]
    assert streams.dropped(progress) == 1 and rows_left(progress) == 0


def by_rule(rows):
    """The list of watched items minute by minute."""
    spans = {k: v // 60 for k, v in GUARANTEE_WINDOWS.items()}
    minute = lambda t: int((t - DAY).total_seconds() // 60)
    out = []
    for item in {r[0] for r in rows}:
        own = sorted((minute(t), kind, None if e is None else minute(e)) for i, t, kind, e in rows if i == item)
        end, fired = None, set()
        for now in range(-10, 6000):
            for _, kind, e in [r for r in own if r[0] == now]:
                if kind == "seed":
                    end, fired = e, set()
                elif kind == "gone":
                    end = None
                elif end is not None and e is not None:
                    end = e
                if end is not None and end <= now:
                    end = None
                due = [] if end is None else [k for k, v in spans.items() if k not in fired and end - now <= v]
                if due:
                    out.append((item, now, min(due, key=spans.get), end))
                    fired |= set(due)
            if end is not None and end <= now:
                end = None
            due = [] if end is None else [k for k, v in spans.items() if k not in fired and end - now <= v]
            if due:
                out.append((item, now, min(due, key=spans.get), end))
                fired |= set(due)
    return sorted(out)


def test_guarantee_timers_equal_the_rule(spark):
    rnd = random.Random(5)
    rows = []
    for item in range(60):
        for _ in range(rnd.randint(1, 5)):
            at = rnd.randint(0, 3000)
            kind = rnd.choice(["seed", "seed", "read", "read", "gone"])
            end = None if kind == "gone" or rnd.random() < 0.1 else at + rnd.choice([-5, 0, 30, 60, 61, 360, 900, 1440, 2000])
            if not any(r[0] == item and r[1] == DAY + timedelta(minutes=at) for r in rows):
                rows.append((item, DAY + timedelta(minutes=at), kind, None if end is None else DAY + timedelta(minutes=end)))
    mixed = sorted(rows, key=lambda r: r[1] + timedelta(minutes=rnd.randint(0, 900)))
    batches = [mixed[k : k + 45] for k in range(0, len(mixed), 45)]
    progress = []
    found = streams.run(parts(spark, WATCH, *batches, [(99, FAR, "read", None)]), lambda r: jobs.guarantee_timers(r, "3 days"), "t", progress)
    minute = lambda t: int((t - DAY).total_seconds() // 60)
    assert sorted((r.item_id, minute(r.tick), r.label, minute(r.guarantee_end)) for r in found.collect()) == by_rule(rows)
    assert streams.dropped(progress) == 0 and rows_left(progress) == 0


def test_marks_of_seen_events_leave_after_a_day(spark):
    event = lambda i, h: (i, DAY + h * HOUR)
    batches = [[event("a", 0), event("b", 0), event("a", 1)], [event("a", 10)], [event("c", 60)], [event("d", 120)], [event("a", 121), event("b", 100)]]
    found = streams.run(parts(spark, "event_id string, occurred_at timestamp", *batches), jobs.deduplicated, "t")
    hours = sorted((r.event_id, (r.occurred_at - DAY) / HOUR) for r in found.collect())
    assert [h for h in hours if h[0] in "cd"] == [("c", 60), ("d", 120)]
    assert [i for i, _ in hours] == ["a", "a", "b", "b", "c", "d"] and ("a", 121) in hours and ("b", 100) in hours


def test_state_is_kept_by_groups_of_items(spark):
    """Calls to the state store go by its rows: 6,000 items that wait have fewer rows than there are groups, thrice."""
    progress = []
    rows = spark.range(6000).select(F.col("id").alias("item_id"), F.explode(F.array(*[F.lit(DAY - h * HOUR) for h in (20, 5, -1)])).alias("tick"), F.lit(DAY).alias("guarantee_end"))
    far = spark.createDataFrame([(None, FAR, DAY)], "item_id long, tick timestamp, guarantee_end timestamp")
    found = streams.run([rows, far], lambda r: jobs.guarantee_levels(r, "3 days"), "t", progress)
    got = found.groupBy("tick", "label").agg(F.count("*"), F.countDistinct("item_id")).collect()
    assert sorted(tuple(r) for r in got) == [(DAY - 20 * HOUR, "24h", 6000, 6000), (DAY - 5 * HOUR, "6h", 6000, 6000)]
    assert max(op.numRowsTotal for p in progress for op in p.stateOperators) <= 3 * ordered.BUCKETS and rows_left(progress) == 0


def test_ordered_rows_keep_nulls_and_long_numbers(spark):
    """Frames would make fractions of whole numbers beside nulls; a time that frames can't hold waits on."""
    big = (1 << 62) + 1
    seen = lambda key, state, rows, until: (None, [(key, at, number, text) for at, number, text in rows], None)
    rows = [(1, DAY, big, None), (1, DAY, None, "b"), (2, DAY + HOUR, -big, ""), (3, datetime(9000, 1, 1), 1, "x")]
    found = streams.run(
        parts(spark, "k long, at timestamp, number long, text string", rows, [(None, datetime(2200, 1, 1), 0, "")]),
        lambda r: ordered.in_order(r, "k", "at", "0 seconds", "number long, text string", "k long, us long, number long, text string", seen), "t")
    assert sorted([r.k, r.number, r.text] for r in found.where("k is not null").collect() if r.number is not None) == [[1, big, None], [2, -big, ""]]
    assert [tuple(r) for r in found.where("number is null").select("k", "text").collect()] == [(1, "b")]
