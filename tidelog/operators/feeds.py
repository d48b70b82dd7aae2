"""Account feeds: rows above a mark, not seen before, as typed events."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidelog.functions.ids import event_id, keyed_hash, payment_hash
from tidelog.functions.payload import encoded, guarantee_time, iso, payload, unix_time
from tidelog.operators.log import typed
from tidelog.schemas import EVENT_COLUMNS, GUARANTEE_WINDOWS, INVOICE_EVENTS, NOTIFICATION_EVENTS, NOTIFICATION_FALLBACKS, PAYMENT_EVENTS, SEEN_SECONDS


def mapped(column: Column, table: Mapping[str, str]) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), column)


def payment_events(operations: DataFrame, table: Mapping[str, str] = PAYMENT_EVENTS) -> DataFrame:
    """Operations with ``event_type``; null where the type isn't mapped."""
    return operations.withColumn("event_type", F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), F.col("operation_type")))


def payment_payload() -> Column:
    """The payload of a payment event: money as text, the hold's end as ISO-8601 text or null."""
    c = F.col
    ends = iso(unix_time(c("hold_end_date")))
    return payload(
        operation_id=c("operation_id"), amount=c("amount").cast("string"), currency=c("currency"), counterparty_id=c("counterparty_id"),
        counterparty_username=c("counterparty_username"), fee=c("fee"), is_hold=c("is_hold"), hold_end_date=ends, item_id=c("item_id"), comment=c("comment"),
    )


def notification_events(notifications: DataFrame, table: Mapping[str, str] = NOTIFICATION_EVENTS) -> DataFrame:
    """Adds aggregate_id, event_type, item_id, claim_id, buyer_id and ``rejected`` (a reason).

    A missing key takes its default, a null stays null, and what isn't a whole number rejects
    the row; only mapped types read ``extra``."""
    extra = F.from_json("extra", "map<string,string>")
    rows = notifications.withColumn("_extra", F.coalesce(extra, F.create_map().cast("map<string,string>")))
    rows = rows.withColumn("_type", F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), F.col("content_type")))
    whole = lambda k: F.expr(f"try_cast(regexp_replace(try_element_at(_extra, '{k}'), '[.]0+$', '') as bigint)")
    wrong = lambda k: F.expr(f"try_element_at(_extra, '{k}')").isNotNull() & whole(k).isNull()
    bad = F.when(wrong("item_id"), "item_id").when(wrong("claim_id"), "claim_id").when(wrong("buyer_id"), "buyer_id")
    value = lambda k, default: F.when(F.expr(f"map_contains_key(_extra, '{k}')"), whole(k)).otherwise(default)
    none, own = F.lit(None).cast("long"), F.col("notification_id")
    claims = F.col("_type").isin("dispute_opened", "claim_filed")
    known = F.col("_type").isNotNull()
    return rows.select(
        *notifications.columns,
        F.concat_ws(":", F.lit("notif"), "kind", "notification_id").alias("aggregate_id"),
        F.coalesce("_type", mapped(F.col("kind"), NOTIFICATION_FALLBACKS)).alias("event_type"),
        F.when(known, value("item_id", F.when(claims, none).otherwise(own))).alias("item_id"),
        F.when(known & claims, value("claim_id", own)).alias("claim_id"),
        F.when(known & ~claims, value("buyer_id", none)).alias("buyer_id"),
        F.when(known & bad.isNotNull(), F.concat(F.lit("notification_extra_invalid:"), bad)).alias("rejected"),
    )


def invoice_events(invoices: DataFrame) -> DataFrame:
    kind = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in INVOICE_EVENTS.items() for x in pair]), F.col("status")), F.lit("invoice_created"))
    dedup = F.coalesce(F.nullif(F.col("event_id"), F.lit("")), F.concat_ws(":", "invoice_id", "status"))
    return invoices.withColumn("event_type", kind).withColumn("dedup_key", dedup)


def unseen(rows: DataFrame, seen: DataFrame, key: str, hash_: str, now: Column | None = None) -> DataFrame:
    """Rows whose (key, hash) isn't marked; a changed hash passes, and marks older than a day count no more."""
    marks = seen if now is None else seen.where(F.col("marked_at") > now - F.expr(f"interval {SEEN_SECONDS} seconds"))
    return rows.join(marks.select(key, hash_), [key, hash_], "left_anti")


def above_mark(rows: DataFrame, marks: DataFrame, key: str, id_: str) -> DataFrame:
    """Rows with an id above their key's mark (no mark: all)."""
    return rows.join(marks.select(key, F.col("mark").alias("_mark")), key, "left").where(F.col(id_) > F.coalesce("_mark", F.lit(0))).drop("_mark")


def new_marks(rows: DataFrame, key: str, id_: str) -> DataFrame:
    return rows.groupBy(key).agg(F.max(id_).alias("mark"))


def advanced_marks(rows: DataFrame, marks: DataFrame, key: str, id_: str) -> DataFrame:
    """The marks after ``rows``: each key's greatest id so far; a mark never goes back."""
    both = marks.select(key, "mark").unionByName(new_marks(rows, key, id_))
    return both.groupBy(key).agg(F.max("mark").alias("mark"))


def payment_job(operations: DataFrame, marks: DataFrame, seen: DataFrame, poll_epoch: int, occurred_at: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One poll of the payment feeds: log events (with operation_id, by which they are in order), rows
    newly seen (operation_id, content_hash) and the accounts' marks after it.

    Operations at or below their account's mark, and pairs of id and hash that are seen, give
    nothing. Unmapped operations are marked as seen and give no event. Repeated rows count once;
    a changed amount or type is another event."""
    # own accounts are few: joined by their id, all operations would meet in as many tasks
    rows = above_mark(operations, F.broadcast(marks), "account_id", "operation_id")
    rows = rows.withColumn("content_hash", payment_hash(F.col("operation_id"), F.col("operation_type"), F.col("amount").cast("string")))
    new = unseen(rows.dropDuplicates(["operation_id", "content_hash"]), seen, "operation_id", "content_hash")
    typed = payment_events(new).where("event_type is not null")
    events = typed.withColumns({"aggregate_id": F.col("operation_id").cast("string"), "poll_epoch": F.lit(poll_epoch).cast("long"), "schema_version": F.lit(1), "occurred_at": occurred_at, "payload": payment_payload()})
    events = events.withColumn("event_id", event_id(F.col("aggregate_id"), F.col("event_type"), F.col("content_hash"), F.col("poll_epoch")))
    return events.select("operation_id", *EVENT_COLUMNS), new.select("operation_id", "content_hash"), advanced_marks(rows, marks, "account_id", "operation_id")


def feed_changed(rows: DataFrame, marks: DataFrame, key: str, id_: str) -> DataFrame:
    """Per feed: its newest id, and whether that is above the mark (no mark: it is)."""
    return new_marks(rows, key, id_).withColumnRenamed("mark", "newest").join(marks, key, "left").select(key, "newest", (F.col("newest") > F.coalesce("mark", F.lit(0))).alias("changed"))


def conversation_events(conversations: DataFrame, messages: DataFrame, known: DataFrame, updates: DataFrame, marks: DataFrame) -> DataFrame:
    """new_conversation for those not in ``known``, and new_message for messages above the mark of
    conversations that are new, unread or at an update not in ``updates``."""
    c = conversations.join(known.select("conversation_id", F.lit(True).alias("_known")), "conversation_id", "left")
    c = c.join(updates.select("conversation_id", "conversation_update_date", F.lit(True).alias("_same")), ["conversation_id", "conversation_update_date"], "left")
    fresh = c.where("_known is null").select("conversation_id", F.lit("new_conversation").alias("event_type"), F.lit(None).cast("long").alias("message_id"))
    due = c.where("_known is null or _same is null or is_unread").select("conversation_id")
    new = above_mark(messages.join(due, "conversation_id", "left_semi"), marks, "conversation_id", "message_id")
    return fresh.unionByName(new.select("conversation_id", F.lit("new_message").alias("event_type"), "message_id"))


def rating_changes(profiles: DataFrame, poll: str = "poll") -> DataFrame:
    """Polls at which a user's counters differ from the poll before; the first sighting tells nothing."""
    user = Window.partitionBy("user_id").orderBy(poll)
    d = lambda c: (F.col(c) - F.lag(c).over(user))
    out = profiles.withColumn("delta_likes", d("user_like_count")).withColumn("delta_dislikes", d("user_dislike_count"))
    return out.where("delta_likes != 0 or delta_dislikes != 0")


def watch_list(purchases: DataFrame, lots: DataFrame) -> DataFrame:
    """item_id and guarantee_end of purchases whose lot is known and whose guarantee is a time."""
    return purchases.join(lots.select("item_id", "guarantee"), "item_id").withColumn("guarantee_end", guarantee_time(F.col("guarantee"))).where("guarantee_end is not null")


def threshold_crossings(watched: DataFrame, ticks: DataFrame, windows: Mapping[str, int] = GUARANTEE_WINDOWS) -> DataFrame:
    """For each watched item: the first tick in each window before its end; of windows that fire
    at one tick only the nearest counts.

    Ticks before ``watched_from``, where ``watched`` has that column, are of no account. An as-of
    join: both sides meet in buckets as long as the shortest window or as the
    longest gap asks, so an item meets a few ticks, never all."""
    size = min(windows.values())
    spans = F.explode(F.map_entries(F.create_map(*[F.lit(x) for pair in windows.items() for x in pair]))).alias("w")
    start = F.col("watched_from") if "watched_from" in watched.columns else F.lit(None).cast("timestamp")
    items = watched.select("item_id", "guarantee_end", start.alias("since"), spans).select("item_id", "guarantee_end", "since", F.col("w.key").alias("label"), F.col("w.value").alias("span"))
    end = F.col("guarantee_end").cast("timestamp").cast("long")
    items = items.withColumn("bucket", F.explode(F.sequence(F.floor((end - F.col("span")) / size), F.floor(end / size))))
    at = ticks.select("tick").withColumn("bucket", F.floor(F.col("tick").cast("timestamp").cast("long") / size))
    tick = F.col("tick").cast("timestamp").cast("long")
    hit = items.join(at, "bucket").where((tick >= end - F.col("span")) & (tick < end) & (F.col("since").isNull() | (F.col("tick") >= F.col("since"))))
    first = hit.groupBy("item_id", "guarantee_end", "label", "span").agg(F.min("tick").alias("tick"))
    return first.groupBy("item_id", "guarantee_end", "tick").agg(F.min_by("label", "span").alias("label"))


def guarantee_levels(watches: DataFrame) -> DataFrame:
    """Rows (item_id, tick, guarantee_end) where the level 1-3 exceeds all before: ends may move."""
    left = F.col("guarantee_end").cast("timestamp").cast("long") - F.col("tick").cast("timestamp").cast("long")
    level = F.when(left <= 0, 0).when(left <= 3600, 3).when(left <= 21600, 2).when(left <= 86400, 1).otherwise(0)
    before = Window.partitionBy("item_id").orderBy("tick").rowsBetween(Window.unboundedPreceding, -1)
    out = watches.withColumn("level", level)
    return out.withColumn("_most", F.coalesce(F.max("level").over(before), F.lit(0))).where(F.col("level") > F.col("_most")).drop("_most")


def logged(rows: DataFrame, *fields: str, tags: Mapping[str, str] | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """Rows of the log from rows with event_type, aggregate_id, content_hash, poll_epoch and occurred_at, their
    payload made of ``fields`` and ``tags``; ``keep`` names further columns to keep."""
    rows = rows.withColumns({"schema_version": F.lit(1), "poll_epoch": F.col("poll_epoch").cast("long"), "payload": encoded(rows, *fields, tags=tags)})
    return rows.withColumn("event_id", event_id(F.col("aggregate_id"), F.col("event_type"), F.col("content_hash"), F.col("poll_epoch"))).select(*EVENT_COLUMNS, *keep)


def notification_job(rows: DataFrame, marks: DataFrame, seen: DataFrame, poll_epoch: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """One poll of the notification feeds: log events, rejected rows, rows newly seen (notification_id,
    content_hash) and the feeds' marks (kind, mark).

    A feed whose newest id isn't above its mark tells nothing. Rows seen with the same content type
    and time give nothing; rejected rows count as seen, so they are told once."""
    changed = feed_changed(rows, marks, "kind", "notification_id").where("changed").select("kind")
    due = rows.join(F.broadcast(changed), "kind", "left_semi").withColumn("content_hash", keyed_hash(F.col("content_type"), F.col("created_at")))
    new = unseen(due.dropDuplicates(["kind", "notification_id", "content_hash"]), seen, "notification_id", "content_hash")
    typed = notification_events(new.withColumn("occurred_at", F.timestamp_seconds("created_at")).withColumn("poll_epoch", F.lit(poll_epoch)))
    good = typed.where("rejected is null").drop("created_at").withColumn("created_at", F.col("occurred_at"))
    fallback = F.col("event_type").isin(list(NOTIFICATION_FALLBACKS.values()))
    claims = F.col("event_type").isin("dispute_opened", "claim_filed")
    events = logged(good.where(claims), "claim_id", "item_id").unionByName(logged(good.where(~claims & ~fallback), "item_id", "buyer_id")).unionByName(logged(good.where(fallback), "notification_id", "content_type", "created_at"))
    return events, typed.where("rejected is not null"), new.select("notification_id", "content_hash"), advanced_marks(due, marks, "kind", "notification_id")


def invoice_job(invoices: DataFrame, occurred_at: Column) -> DataFrame:
    """Log events of invoice bodies (invoice_id, status, event_id, amount, currency)."""
    rows = invoice_events(invoices).withColumns({"aggregate_id": F.col("invoice_id"), "content_hash": F.col("dedup_key"), "poll_epoch": F.lit(0), "occurred_at": occurred_at})
    return logged(rows, "invoice_id", "status", "amount", "currency")


def rating_job(changes: DataFrame, occurred_at: Column) -> DataFrame:
    """Log events of counter changes (user_id, poll, counters, deltas, account_alias or null)."""
    key = keyed_hash("rating", F.col("user_id"), F.col("user_like_count"), F.col("user_dislike_count"))
    rows = changes.withColumns({"event_type": F.lit("rating_changed"), "aggregate_id": F.col("user_id").cast("string"), "content_hash": key, "poll_epoch": F.col("poll"), "occurred_at": occurred_at})
    return logged(rows, "user_like_count", "user_dislike_count", "delta_likes", "delta_dislikes", tags={"account_alias": "account_alias"})


def conversation_job(conversations: DataFrame, messages: DataFrame, known: DataFrame, updates: DataFrame, marks: DataFrame, poll_epoch: int, occurred_at: Column) -> tuple[DataFrame, DataFrame]:
    """(log events, marks) of a poll of conversations (CONVERSATION) and their messages (MESSAGE); see
    :func:`conversation_events` for what is told."""
    told = conversation_events(conversations, messages, known, updates, marks).withColumns({"poll_epoch": F.lit(poll_epoch), "occurred_at": occurred_at})
    kind, ident = F.col("event_type"), lambda c: F.col(c).cast("string")
    chats = told.where(kind == "new_conversation").join(conversations.drop("is_unread"), "conversation_id")
    chats = chats.withColumns({"aggregate_id": ident("conversation_id"), "content_hash": keyed_hash("conversation", F.col("conversation_id"))})
    own = messages.select("message_id", F.col("creator_user_id").alias("author_user_id"), F.col("message_body_plain_text").alias("message_text"), F.col("message_is_system").alias("is_system"))
    texts = told.where(kind == "new_message").join(own, "message_id").join(conversations.select("conversation_id", "folder"), "conversation_id")
    texts = texts.withColumns({"aggregate_id": ident("message_id"), "content_hash": keyed_hash("message", F.col("message_id"))})
    events = logged(chats, "conversation_id", "conversation_title", "creator_user_id", "creator_username", "folder").unionByName(
        logged(texts, "message_id", "conversation_id", "author_user_id", "message_text", "is_system", "folder"))
    after = marks.select("conversation_id", "mark").unionByName(texts.groupBy("conversation_id").agg(F.max("message_id").alias("mark")))
    return events, after.groupBy("conversation_id").agg(F.max("mark").alias("mark"))


def guarantee_job(fired: DataFrame, poll_epoch: Column) -> DataFrame:
    """Log events of guarantees that a window has opened for (item_id, tick, label, guarantee_end)."""
    rows = fired.withColumns({"event_type": F.lit("guarantee_expiring"), "aggregate_id": F.col("item_id").cast("string"), "content_hash": keyed_hash("guarantee", F.col("item_id"), F.col("label")), "poll_epoch": poll_epoch, "occurred_at": F.col("tick")})
    return logged(rows, "item_id", "guarantee_end")


def within_budget(events: DataFrame, category: str, budget: str, keep: Sequence[str] = ()) -> DataFrame:
    """item_id and price of a category's new lots that cost no more than ``budget``, from rows of the log;
    ``keep`` names further columns of the log to keep."""
    lots = typed(events, ["new_lot"])
    return lots.where((F.col("category") == category) & (F.col("price") <= F.lit(budget).cast("decimal(20,8)"))).select(F.col("aggregate_id").cast("long").alias("item_id"), "price", "event_id", *keep)


def with_alias(rows: DataFrame, accounts: DataFrame) -> DataFrame:
    """The primary alias of each row's account; null if there is none. Own accounts are few and go to all tasks."""
    primary = accounts.where("is_primary").select("account_id", F.col("alias").alias("account_alias"))
    return rows.join(F.broadcast(primary), "account_id", "left")
