"""Subscriptions, fan-out, cursors and what consumers read next."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tidelog.operators.log import counted_before, stable
from tidelog.schemas import ACCOUNT_EVENTS, CATALOG_EVENTS, EVENT_TYPES, LAG_ALARM


def scope_filters(kind: Column, category: Column, account_alias: Column) -> Column:
    """A typed scope as the map of payload fields it asks for."""
    return F.when(kind == "category", F.create_map(F.lit("category"), category)).when(kind == "account", F.create_map(F.lit("account_alias"), account_alias)).otherwise(F.create_map().cast("map<string,string>"))


def filters_scope(filters: Column) -> Column:
    """The scope of a map: category wins, unknown keys mean none."""
    return F.when(F.map_contains_key(filters, "category"), "category").when(F.map_contains_key(filters, "account_alias"), "account").otherwise("none")


def payload_matches(payload: Column, filters: Column) -> Column:
    """Every asked field is in the payload with that text; a missing field never matches."""
    data = F.from_json(payload, "map<string,string>")
    return F.forall(F.map_entries(filters), lambda e: F.coalesce(F.try_element_at(data, e["key"]) == e["value"], F.lit(False)))


def matches(event_type: Column, payload: Column, types: Column, filters: Column) -> Column:
    return F.array_contains(types, event_type) & payload_matches(payload, filters)


def narrowed(types: Column, given: Sequence[str] | None) -> Column:
    """Types given with a query replace the subscription's own."""
    return types if given is None else F.array(*[F.lit(t) for t in given])


def validated(subscriptions: DataFrame, aliases: DataFrame) -> DataFrame:
    """Adds unsupported (types the scope never matches), unknown_types and alias_missing."""
    lists = {"category": CATALOG_EVENTS, "account": ACCOUNT_EVENTS}
    text = lambda xs: F.array(*[F.lit(x) for x in xs])
    allowed = F.when(F.col("scope_kind") == "category", text(lists["category"])).when(F.col("scope_kind") == "account", text(lists["account"]))
    known = aliases.select(F.col("alias").alias("account_alias"), F.lit(True).alias("_known")).distinct()
    out = subscriptions.join(known, "account_alias", "left")
    return out.select(
        *subscriptions.columns,
        F.when(allowed.isNull(), F.array().cast("array<string>")).otherwise(F.array_except("event_types", allowed)).alias("unsupported"),
        F.array_except("event_types", text(EVENT_TYPES)).alias("unknown_types"),
        ((F.col("scope_kind") == "account") & F.col("_known").isNull()).alias("alias_missing"),
    )


#: Payload fields that scopes ask for.
SCOPES = ("category", "account_alias")


#: Events of one key that a task should join, and how many keys may be dealt out at most.
HOT_ROWS = 1_000_000
MOST_HOT = 10_000

_KEY = ["event_type", "_field", "_value"]


def _keyed(log: DataFrame) -> DataFrame:
    """An event once for no scope and once for each scope field it has; its payload is read once."""
    pair = lambda k, v: F.struct(k.alias("k"), v.alias("v"))
    own = F.transform(F.array(*map(F.lit, SCOPES)), lambda k: pair(k, F.try_element_at(F.col("_data"), k)))
    pairs = F.concat(F.array(pair(F.lit(""), F.lit(""))), F.filter(F.coalesce(own, F.array().cast("array<struct<k:string,v:string>>")), lambda p: p["v"].isNotNull()))
    read = log.withColumn("_data", F.from_json("payload", "map<string,string>")).withColumn("_pair", F.explode(pairs))
    return read.withColumns({"_field": F.col("_pair.k"), "_value": F.col("_pair.v")}).drop("_data", "_pair")


def hot_keys(log: DataFrame, rows: int = HOT_ROWS, most: int = MOST_HOT) -> DataFrame:
    """Keys of :func:`fan_out` with more than ``rows`` events, and how many ways to deal them (``_ways``).

    Events are counted where they lie, so a hot key is no hot key here. At most ``most`` keys, as
    none has less than that share of all, so the result may be sent to all tasks."""
    counts = _keyed(log.select("event_type", "payload")).groupBy(*_KEY).agg(F.count("*").alias("_n"))
    total = counts.agg(F.sum("_n").alias("_all"))
    hot = counts.crossJoin(F.broadcast(total)).where((F.col("_n") > rows) & (F.col("_n") > F.col("_all") / most))
    return stable(hot.select(*_KEY, F.ceil(F.col("_n") / rows).alias("_ways")))


def fan_out(log: DataFrame, subscriptions: DataFrame, hot: DataFrame | None = None) -> DataFrame:
    """Each event with each active subscription that matches it.

    The payload is read once per event. An equi-join on type and scope: an event stands once for
    no scope and once for each scope field it has, a subscription for the field it asks for, so
    only those that ask for more fields are compared with a payload again. Events of ``hot`` keys
    (:func:`hot_keys`) are dealt to several tasks, and the key's subscriptions go to each of these."""
    asks = F.col("filters")
    field = F.lit("")
    for name in reversed(SCOPES):
        field = F.when(F.map_contains_key(asks, name), name).otherwise(field)
    asked = subscriptions.where("active").withColumn("event_type", F.explode(F.array_distinct("event_types"))).drop("event_types")
    asked = asked.withColumn("_field", field).withColumn("_value", F.coalesce(F.try_element_at(asks, field), F.lit("")))
    keyed, key = _keyed(log), list(_KEY)
    if hot is not None:
        ways = F.coalesce("_ways", F.lit(1))
        keyed = keyed.join(F.broadcast(hot), _KEY, "left").withColumn("_way", F.pmod(F.xxhash64("seq"), ways)).drop("_ways")
        asked = asked.join(F.broadcast(hot), _KEY, "left").withColumn("_way", F.explode(F.sequence(F.lit(0).cast("long"), ways - 1))).drop("_ways")
        key.append("_way")
    more = F.size("filters") > F.when(F.col("_field") == "", 0).otherwise(1)
    return keyed.join(asked, key).where(~more | payload_matches(F.col("payload"), asks)).drop("_field", "_value", "_way")


def catch_up(log: DataFrame, subscriptions: DataFrame, cursors: DataFrame) -> DataFrame:
    """What each consumer has yet to read: matching events above its cursor (none: 0)."""
    after = subscriptions.join(cursors.select("consumer_name", "last_seq"), "consumer_name", "left").withColumn("last_seq", F.coalesce("last_seq", F.lit(0)))
    # one number, so that the scan of the log skips what all have read
    least = after.where("active").agg(F.min("last_seq")).collect()[0][0] or 0
    return fan_out(log.where(F.col("seq") > least), after).where("seq > last_seq")


def scanned(log: DataFrame, cursors: DataFrame, limit: int) -> DataFrame:
    """consumer_name and seq of the first ``limit`` rows of the log above each cursor (consumer_name, last_seq).

    Cursors and the log's numbers are ranged together, only those above the lowest cursor; a cursor
    learns how many rows lie at or below it, and so the positions of the rows that follow."""
    least = cursors.agg(F.min("last_seq")).collect()[0][0]
    if least is None:
        return cursors.sparkSession.createDataFrame([], "consumer_name string, seq long")
    none = F.lit(None).cast("string")
    numbers = log.where(F.col("seq") > least).select("seq", F.lit(True).alias("is_row"), none.alias("consumer_name"))
    marks = cursors.select(F.col("last_seq").alias("seq"), F.lit(False).alias("is_row"), "consumer_name")
    # a row comes before the cursors that stand at it
    placed = counted_before(numbers.union(marks).withColumn("after", ~F.col("is_row")), ["seq", "after", "consumer_name"], "is_row", "pos")
    wanted = placed.where("not is_row").select("consumer_name", F.explode(F.sequence(F.col("pos") + 1, F.col("pos") + limit)).alias("pos"))
    return wanted.join(placed.where("is_row").select("pos", "seq"), "pos").select("consumer_name", "seq")


def peek(log: DataFrame, subscriptions: DataFrame, cursors: DataFrame, limit: int = 100) -> DataFrame:
    """Per subscription: scan ``limit`` rows after its cursor, then filter. n_items, next_seq (the
    last scanned), last_read_seq, drained. The limit counts scanned rows."""
    at = subscriptions.where("active").join(cursors.select("consumer_name", "last_seq"), "consumer_name", "left").withColumn("last_seq", F.coalesce("last_seq", F.lit(0)))
    got = pending(log, at, limit).groupBy("consumer_name").agg(F.count("*").alias("scanned"), F.count(F.when(F.col("hit"), 1)).alias("n_items"), F.max("seq").alias("next_seq"))
    out = at.select("consumer_name", F.col("last_seq").alias("last_read_seq")).join(got, "consumer_name", "left")
    return out.select("consumer_name", "last_read_seq", F.coalesce("n_items", F.lit(0)).alias("n_items"), F.coalesce("next_seq", "last_read_seq").alias("next_seq"), (F.coalesce("scanned", F.lit(0)) < limit).alias("drained"))


def pending(log: DataFrame, at: DataFrame, limit: int = 100) -> DataFrame:
    """The rows that each subscription of ``at`` (with last_seq) scans, with ``hit``: whether it asks for them."""
    rows = scanned(log, at.select("consumer_name", "last_seq"), limit).join(log, "seq")
    asked = at.select("consumer_name", F.col("event_types").alias("_types"), F.col("filters").alias("_filters"))
    hit = matches(F.col("event_type"), F.col("payload"), F.col("_types"), F.col("_filters"))
    return rows.join(asked, "consumer_name").withColumn("hit", hit).drop("_types", "_filters")


def watermark(cursors: DataFrame) -> DataFrame:
    return cursors.agg(F.min("last_seq").alias("watermark"))


def latest_cursors(commits: DataFrame) -> DataFrame:
    return commits.groupBy("consumer_name").agg(F.max_by("last_seq", "version").alias("last_seq"), F.max("version").alias("version"))


def lag(cursors: DataFrame, log: DataFrame, alarm: int = LAG_ALARM) -> DataFrame:
    top = log.agg(F.coalesce(F.max("seq"), F.lit(0)).alias("_head"))
    return cursors.crossJoin(F.broadcast(top)).select("consumer_name", (F.col("_head") - F.col("last_seq")).alias("lag")).withColumn("alarm", F.col("lag") > alarm)


def replayed(cursors: DataFrame, consumer: str, seq: int) -> DataFrame:
    """Cursors with one set to ``seq``; its next read starts at seq + 1."""
    return cursors.withColumn("last_seq", F.when(F.col("consumer_name") == consumer, F.lit(seq).cast("long")).otherwise(F.col("last_seq")))


def redriven(dead: DataFrame, cursors: DataFrame, consumers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(dead letters left, cursors): a drained consumer goes back to just before its first one."""
    drained = dead.join(consumers, "consumer_name", "left_semi")
    first = drained.groupBy("consumer_name").agg(F.greatest(F.min("seq") - 1, F.lit(0)).alias("_to"))
    moved = cursors.join(first, "consumer_name", "full_outer").select("consumer_name", F.coalesce("_to", "last_seq").alias("last_seq"))
    return dead.join(consumers, "consumer_name", "left_anti"), moved


def start_position(transport: Column, backfill: Column, given: Column, head: Column) -> Column:
    """Where a new subscription starts: webhooks and polling at the head unless they backfill,
    others at the given number (invalid or negative: 0)."""
    return F.when(transport.isin("webhook", "polling"), F.when(backfill, 0).otherwise(head)).otherwise(F.greatest(F.coalesce(given.try_cast("long"), F.lit(0)), F.lit(0))).cast("long")


def confirmed_reads(cursors: DataFrame, requests: DataFrame) -> DataFrame:
    """Cursors after confirmations; they only move forward."""
    upto = requests.groupBy("consumer_name").agg(F.max("up_to_seq").alias("_upto"))
    return cursors.join(upto, "consumer_name", "left").select("consumer_name", F.greatest("last_seq", F.coalesce("_upto", "last_seq")).alias("last_seq"))


def without_inactive(cursors: DataFrame, subscriptions: DataFrame) -> DataFrame:
    off = subscriptions.where("not active").select("consumer_name")
    return cursors.join(off, "consumer_name", "left_anti")
