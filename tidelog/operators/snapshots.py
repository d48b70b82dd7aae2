"""Snapshots of keyed tables: what is new, cheaper, changed or gone."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidelog.functions.payload import resolve_reason
from tidelog.schemas import CONFIRM_CAP, DISAPPEAR_POLLS

KEY = ["category", "item_id"]


def last_wins(observations: DataFrame, keys: Sequence[str], position: Sequence[str]) -> DataFrame:
    """One row per key: the last by position.

    Partitioned by ``category, item_id`` and sorted on, so that a later window over the same
    item needs no further exchange."""
    order = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in position])
    return observations.withColumn("_place", F.row_number().over(order)).where("_place = 1").drop("_place")


def latest_per_poll(observations: DataFrame, position: Sequence[str]) -> DataFrame:
    """:func:`last_wins` within a poll, over the item's rows of all polls.

    The window asks for no finer exchange than a later one over the item, and for none after a join by item_id."""
    item = Window.partitionBy(*KEY).orderBy("poll_epoch", *position)
    rows = observations.withColumn("_next", F.lead(F.struct("poll_epoch")).over(item))
    return rows.where(F.col("_next").isNull() | ~F.col("_next.poll_epoch").eqNullSafe(F.col("poll_epoch"))).drop("_next")


def numbered_polls(polls: DataFrame) -> DataFrame:
    """category, poll_epoch, n (dense number from 1), last (the category's number of polls).

    Polls that returned nothing count, so they come from the list of polls, not from lots;
    gaps in poll_epoch don't count as misses."""
    order = Window.partitionBy("category").orderBy("poll_epoch")
    whole = Window.partitionBy("category")
    return polls.select("category", "poll_epoch").distinct().withColumn("n", F.row_number().over(order)).withColumn("last", F.count("*").over(whole))


def _told(at: DataFrame, misses: int) -> tuple[DataFrame, DataFrame]:
    """(events by number of poll, each item's last row) of rows category, item_id, n, last, price,
    content_hash, seed. Seeds are where a baseline last saw an item; they tell nothing themselves."""
    item = Window.partitionBy(*KEY).orderBy("n")
    seen = at.select("*", F.lag("n").over(item).alias("pn"), F.lag("price").over(item).alias("pprice"), F.lag("content_hash").over(item).alias("phash"), F.lead("n").over(item).alias("nn"))
    event = lambda kind, n, old=None: F.struct(F.lit(kind).alias("event_type"), n.cast("long").alias("n"), (F.col("pprice") if old else F.lit(None).cast(at.schema["price"].dataType)).alias("old_price"))
    came_back = F.col("n") - F.col("pn") > misses
    now = (
        F.when(F.col("seed"), None)
        .when(F.col("pn").isNull(), F.when(F.col("n") > 1, event("new_lot", F.col("n"))))
        .when(came_back, event("new_lot", F.col("n")))
        .when(F.col("price") < F.col("pprice"), event("price_dropped", F.col("n"), True))
        .when(~F.col("content_hash").eqNullSafe(F.col("phash")), event("lot_updated", F.col("n")))
    )
    gone = F.when(F.coalesce(F.col("nn") - 1, F.col("last")) - F.col("n") >= misses, event("lot_disappeared", F.col("n") + misses))
    made = seen.select(*KEY, "price", "content_hash", F.explode(F.filter(F.array(now, gone), lambda e: e.isNotNull())).alias("e"))
    lost = F.col("e.event_type") == "lot_disappeared"
    made = made.select(*KEY, "e.event_type", "e.n", "e.old_price", F.when(~lost, F.col("price")).alias("price"), F.when(lost, F.concat(F.lit("gone:"), F.col("item_id"))).otherwise(F.col("content_hash")).alias("content_hash"))
    return made, seen.where("nn is null")


def history_diff(lots: DataFrame, polls: DataFrame, misses: int = DISAPPEAR_POLLS) -> DataFrame:
    """All lot events of whole histories in one pass.

    ``lots`` holds one row per item and poll. Result: category, item_id, n, poll_epoch,
    event_type, old_price, price, content_hash (of a lot that is gone: ``gone:<id>``).
    An item's first poll of its category only seeds; ``misses`` polls without it mean gone."""
    numbers = numbered_polls(polls)
    at = lots.join(numbers, ["category", "poll_epoch"]).select(*KEY, "n", "last", "price", "content_hash", F.lit(False).alias("seed"))
    return _told(at, misses)[0].join(numbers.select("category", F.col("n").cast("long").alias("n"), "poll_epoch"), ["category", "n"])


#: Baseline rows, and the polls that a category has been through: their number and the last one's epoch.
BASELINE = "category string, item_id long, price decimal(20,8), content_hash string, miss_count int"
POLLED = "category string, n long, poll_epoch long"


def history_step(lots: DataFrame, polls: DataFrame, baseline: DataFrame, polled: DataFrame, misses: int = DISAPPEAR_POLLS, position: Sequence[str] = ()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """:func:`history_diff` continued: (events, baseline, polled) after further ``polls``, all in one pass.

    ``lots`` holds one row per item and poll, or several of which the last by ``position`` counts (dealt by
    item once, together with the baseline), ``baseline`` (BASELINE) the polled categories' items before
    and ``polled`` (POLLED) the polls before; what comes back covers the categories of ``polls``.
    Polls at or before a category's last are left out, so a repeated step tells nothing."""
    done = polled.select("category", F.col("n").alias("_before"), F.col("poll_epoch").alias("_epoch"))
    order = Window.partitionBy("category").orderBy("poll_epoch")
    new = polls.select("category", "poll_epoch").distinct().join(done, "category", "left").where(F.col("_epoch").isNull() | (F.col("poll_epoch") > F.col("_epoch")))
    before = F.coalesce("_before", F.lit(0))
    numbers = new.select("category", "poll_epoch", (before + F.row_number().over(order)).alias("n"), (before + F.count("*").over(Window.partitionBy("category"))).alias("last"), before.alias("_before"))
    # a step's polls are few beside their lots, whose files may look small
    numbers = F.broadcast(numbers)
    rows = lots.join(numbers, ["category", "poll_epoch"]).select(*KEY, "n", "last", F.col("price").cast("decimal(20,8)").alias("price"), "content_hash", F.lit(False).alias("seed"), *position)
    taken = numbers.groupBy("category").agg(F.max("last").alias("last"), F.max("_before").alias("_before"), F.max("poll_epoch").alias("poll_epoch"))
    seeds = baseline.join(taken, "category").select(*KEY, (F.col("_before") - F.col("miss_count")).alias("n"), "last", "price", "content_hash", F.lit(True).alias("seed"))
    both = rows.unionByName(seeds, allowMissingColumns=True)
    if position:
        later = F.lead("n").over(Window.partitionBy(*KEY).orderBy("n", *position))
        both = both.withColumn("_next", later).where(~F.col("_next").eqNullSafe(F.col("n"))).drop("_next", *position)
    made, last = _told(both, misses)
    events = made.join(numbers.select("category", "n", "poll_epoch"), ["category", "n"])
    kept = last.where(F.col("last") - F.col("n") < misses).select(*KEY, "price", "content_hash", (F.col("last") - F.col("n")).cast("int").alias("miss_count"))
    return events, kept, taken.select("category", F.col("last").alias("n"), "poll_epoch")


def bootstrap_markers(lots: DataFrame, polls: DataFrame) -> DataFrame:
    """The first poll of each category with its number of distinct lots (0 if it was empty)."""
    first = polls.groupBy("category").agg(F.min("poll_epoch").alias("poll_epoch"))
    counted = lots.join(first, ["category", "poll_epoch"]).groupBy("category").agg(F.countDistinct("item_id").alias("lot_count"))
    return first.join(counted, "category", "left").select("category", "poll_epoch", F.coalesce("lot_count", F.lit(0)).cast("long").alias("lot_count"))


def diff(baseline: DataFrame, snapshot: DataFrame) -> DataFrame:
    """One poll against the baseline: every item with ``event_type`` (null: nothing to tell) and ``present``."""
    b = baseline.select(*KEY, F.col("price").alias("old_price"), F.col("content_hash").alias("old_hash"), "miss_count")
    s = snapshot.select(*KEY, "price", "content_hash", F.lit(True).alias("present"))
    both = b.join(s, KEY, "full_outer").withColumn("present", F.coalesce("present", F.lit(False)))
    kind = F.when(F.col("present") & F.col("old_hash").isNull() & F.col("miss_count").isNull(), "new_lot").when(F.col("present") & (F.col("price") < F.col("old_price")), "price_dropped").when(F.col("present") & ~F.col("content_hash").eqNullSafe(F.col("old_hash")), "lot_updated")
    return both.withColumn("event_type", kind)


def next_baseline(compared: DataFrame, misses: int = DISAPPEAR_POLLS) -> DataFrame:
    """The baseline after the poll of :func:`diff`; ``ripe`` items have missed enough polls and go."""
    missed = F.when(F.col("present"), F.lit(0)).otherwise(F.col("miss_count") + 1)
    keep = lambda new, old: F.when(F.col("present"), F.col(new)).otherwise(F.col(old)).alias(new)
    return compared.select(*KEY, keep("price", "old_price"), keep("content_hash", "old_hash"), missed.alias("miss_count")).withColumn("ripe", F.col("miss_count") >= misses)


def absent(baseline: DataFrame, snapshot: DataFrame) -> DataFrame:
    return baseline.select(*KEY).join(snapshot.select(*KEY), KEY, "left_anti")


def confirmed(gone: DataFrame, states: DataFrame, cap: int = CONFIRM_CAP) -> DataFrame:
    """Reason and confidence of each lot that is gone: at most ``cap`` lookups per poll of a
    category, by item_id; the others stay unknown.

    Only the first ``cap`` of each poll leave their tasks to be ranked, and only they meet the states."""
    poll = ["category", "poll_epoch"]
    place = Window.partitionBy(*poll).orderBy("item_id")
    looked = gone.select(*poll, "item_id").withColumn("_place", F.row_number().over(place)).where(F.col("_place") <= cap).drop("_place")
    known = looked.join(states.select("item_id", "item_state"), "item_id").withColumn("_why", resolve_reason(F.col("item_state"), F.lit(True))).drop("item_state")
    out = gone.join(known, [*poll, "item_id"], "left").withColumn("_why", F.coalesce("_why", resolve_reason(F.lit(None).cast("string"), F.lit(False))))
    return out.select(*gone.columns, "_why.reason", "_why.confidence")


def confirmed_events(events: DataFrame, states: DataFrame, cap: int = CONFIRM_CAP) -> DataFrame:
    """:func:`confirmed` on events of all types: reason and confidence stand at lot_disappeared only.

    ``events`` are read twice; write them before if they are dear."""
    gone = F.col("event_type") == "lot_disappeared"
    none = F.lit(None).cast("string")
    return confirmed(events.where(gone), states, cap).unionByName(events.where(~gone).withColumns({"reason": none, "confidence": none}))


def lookup(ids: DataFrame, lots: DataFrame) -> DataFrame:
    """Lots of an id list (column ``ids``) with ``pos``; unknown ids are skipped."""
    return ids.select(F.posexplode("ids").alias("pos", "item_id")).join(lots, "item_id").orderBy("pos")


def catalog(lots: DataFrame, category: str | None = None, pmin=None, pmax=None, title: str | None = None, games: Sequence[str] | None = None) -> DataFrame:
    """Lots that meet every given condition."""
    tests: list[Column] = []
    if category is not None:
        tests.append(F.col("category") == category)
    if pmin is not None:
        tests.append(F.col("price") >= F.lit(pmin).cast("decimal(20,8)"))
    if pmax is not None:
        tests.append(F.col("price") <= F.lit(pmax).cast("decimal(20,8)"))
    if title is not None:
        tests.append(F.col("title").contains(title))
    if games is not None:
        tests.append(F.col("game").isin(list(games)))
    for test in tests:
        lots = lots.where(test)
    return lots


ORDERS = {"price_to_up": ("price", True), "price_to_down": ("price", False), "newest": ("published_at", False), "oldest": ("published_at", True)}


def top_lots(lots: DataFrame, order: str, n: int) -> DataFrame:
    column, up = ORDERS[order]
    return lots.orderBy(F.col(column).asc() if up else F.col(column).desc(), "item_id").limit(n)


def newest_per_poll(lots: DataFrame, n: int = 50) -> DataFrame:
    """The scan window: the newest ``n`` lots of each poll of a category."""
    order = Window.partitionBy("category", "poll_epoch").orderBy(F.desc("published_at"), "item_id")
    return lots.withColumn("_place", F.row_number().over(order)).where(F.col("_place") <= n).drop("_place")


def deals(lots: DataFrame, threshold: str) -> DataFrame:
    return lots.where(F.col("price") < F.col("ai_price") * F.lit(threshold).cast("decimal(4,2)"))


def events_per_poll(events: DataFrame) -> DataFrame:
    """Events by category, poll and type; the bootstrap marker isn't one."""
    return events.where("event_type != 'snapshot_initialized'").groupBy("category", "poll_epoch", "event_type").agg(F.count("*").alias("n_events"))
