"""Feeds as rows of the log, payloads at any depth, typed views, hot keys."""

import json
import random
from datetime import date, datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tidelog.functions import ids, payload as pl
from tidelog.operators import consume, delivery, feeds, log
from tidelog.schemas import EVENT_COLUMNS, EVENT_TYPES, PAYLOADS, RESERVED_EVENTS

AT = datetime(2026, 1, 2, 3, 4, 5)


def test_payloads_at_any_depth(spark):
    """Money and times are text wherever they stand, keys of maps are text, nulls of fields stay, tags without a value go."""
    schema = "lot struct<price:decimal(10,2),seen:timestamp,days:array<date>,by:struct<id:long>>, prices map<int,decimal(6,3)>, seen map<boolean,array<timestamp>>, share double, alias string, lot_tag string, empty array<struct<a:decimal(3,1)>>"
    row = ((Decimal("1.50"), AT, [date(2026, 1, 1), None], None), {1: Decimal("2.125"), 2: None}, {True: [AT.replace(microsecond=5), None]}, 0.5, None, "loses", [])
    rows = spark.createDataFrame([row, (None, None, None, None, "a\"é", "x", None)], schema)
    made = [json.loads(r[0]) for r in rows.select(pl.encoded(rows, "lot", "prices", "seen", "share", "empty", tags={"account_alias": "alias", "lot": "lot_tag"})).collect()]
    assert made[0] == {
        "lot": {"price": "1.50", "seen": "2026-01-02T03:04:05+00:00", "days": ["2026-01-01", None], "by": None}, "prices": {"1": "2.125", "2": None},
        "seen": {"True": ["2026-01-02T03:04:05.000005+00:00", None]}, "share": "0.5", "empty": [],
    }
    assert made[1] == {"account_alias": 'a"é', "lot": None, "prices": None, "seen": None, "share": None, "empty": None}
    only = [r[0] for r in rows.select(pl.encoded(rows, tags={"t": "alias"})).collect()]
    assert only == ["{}", '{"t":"a\\"é"}']
    with pytest.raises(TypeError):
        pl.encoded(spark.createDataFrame([(b"x",)], "b binary"), "b")


def test_notification_job(spark):
    """A feed at its mark is left alone; seen rows give nothing; a rejected row is told once and counts as seen."""
    rows = [("market", 5, "market_dispute_opened", 100, '{"claim_id":9}'), ("market", 6, "market_lot_reserved", 100, '{"item_id":"x"}'), ("market", 7, "other", 100, "{}"), ("market", 4, "other", 90, "{}"), ("market", 7, "other", 100, "{}"), ("nomarket", 3, "other", 100, "{}")]
    feed = spark.createDataFrame(rows, "kind string, notification_id long, content_type string, created_at long, extra string")
    marks = spark.createDataFrame([("nomarket", 8)], "kind string, mark long")
    seen = spark.createDataFrame([(4, "other:90")], "notification_id long, content_hash string")
    events, rejected, new, after = feeds.notification_job(feed, marks, seen, 3)
    got = sorted((r.event_type, r.aggregate_id, r.content_hash, r.poll_epoch, json.loads(r.payload)) for r in events.collect())
    assert got == [
        ("dispute_opened", "notif:market:5", "market_dispute_opened:100", 3, {"claim_id": 9, "item_id": None}),
        ("market_notification_received", "notif:market:7", "other:100", 3, {"notification_id": 7, "content_type": "other", "created_at": "1970-01-01T00:01:40+00:00"}),
    ]
    assert [r.notification_id for r in rejected.collect()] == [6] and sorted(r.notification_id for r in new.collect()) == [5, 6, 7]
    assert {r.kind: r.mark for r in after.collect()} == {"market": 7, "nomarket": 8}
    again = feeds.notification_job(feed, after, seen.union(new), 4)
    assert again[0].count() == again[1].count() == 0
    assert events.columns == EVENT_COLUMNS


def test_conversation_and_other_jobs(spark):
    chats = spark.createDataFrame([(1, "one", 7, "u7", 50, False, "inbox"), (2, "two", 8, "u8", 60, False, "inbox")], "conversation_id long, conversation_title string, creator_user_id long, creator_username string, conversation_update_date long, is_unread boolean, folder string")
    texts = spark.createDataFrame([(11, 1, 7, "hi", 50, False), (12, 1, 9, None, 51, True), (21, 2, 8, "old", 60, False)], "message_id long, conversation_id long, creator_user_id long, message_body_plain_text string, message_create_date long, message_is_system boolean")
    frame = lambda rows, ddl: spark.createDataFrame(rows, ddl)
    events, marks = feeds.conversation_job(chats, texts, frame([(2,)], "conversation_id long"), frame([(2, 60)], "conversation_id long, conversation_update_date long"), frame([(1, 11), (2, 5)], "conversation_id long, mark long"), 2, F.lit(AT))
    got = sorted((r.event_type, r.aggregate_id, json.loads(r.payload)) for r in events.collect())
    assert got == [
        ("new_conversation", "1", {"conversation_id": 1, "conversation_title": "one", "creator_user_id": 7, "creator_username": "u7", "folder": "inbox"}),
        ("new_message", "12", {"message_id": 12, "conversation_id": 1, "author_user_id": 9, "message_text": None, "is_system": True, "folder": "inbox"}),
    ]
    assert {r.conversation_id: r.mark for r in marks.collect()} == {1: 12, 2: 5}
    bill = feeds.invoice_job(frame([("i1", "paid", "", "1.5", None)], "invoice_id string, status string, event_id string, amount string, currency string"), F.lit(AT)).collect()[0]
    assert (bill.event_type, bill.content_hash, bill.poll_epoch, json.loads(bill.payload)) == ("invoice_paid", "i1:paid", 0, {"invoice_id": "i1", "status": "paid", "amount": "1.5", "currency": None})
    fired = feeds.guarantee_job(frame([(3, AT, "6h", AT)], "item_id long, tick timestamp, label string, guarantee_end timestamp"), F.lit(4)).collect()[0]
    assert (fired.content_hash, json.loads(fired.payload)) == ("guarantee:3:6h", {"item_id": 3, "guarantee_end": "2026-01-02T03:04:05+00:00"})


def test_every_emitted_type_has_a_view(spark):
    assert set(PAYLOADS) == set(EVENT_TYPES) - set(RESERVED_EVENTS)
    rows = [(1, "guarantee_expiring", '{"item_id":3,"guarantee_end":"2026-01-02T03:04:05+00:00","more":[1]}'), (2, "guarantee_expiring", '{"item_id":"x"}'), (3, "guarantee_expiring", "{broken"), (4, "income_received", '{"amount":"12.50","is_hold":true,"fee":1}'), (5, "guarantee_expiring", None)]
    views = log.typed_views(spark.createDataFrame(rows, "seq long, event_type string, payload string"))
    assert sorted((r.seq, r.item_id, r.guarantee_end) for r in views["guarantee_expiring"].collect()) == [(1, 3, AT), (2, None, None), (3, None, None), (5, None, None)]
    paid = views["income_received"].collect()
    assert [(r.amount, r.is_hold, r.fee, r.comment) for r in paid] == [(Decimal("12.50000000"), True, 1, None)]
    budget = spark.createDataFrame([("e1", "new_lot", "7", '{"category":"a","price":"5.00"}'), ("e2", "new_lot", "8", '{"category":"a","price":"5.01"}'), ("e3", "new_lot", "9", '{"category":"b","price":"1"}')], "event_id string, event_type string, aggregate_id string, payload string")
    assert [r.item_id for r in feeds.within_budget(budget, "a", "5").collect()] == [7]


def test_ids_of_rows_with_nulls_never_meet(spark):
    rows = spark.createDataFrame([("a", None, "b"), ("a", "b", None), (None, "a", "b")], "x string, y string, z string")
    assert {r[0] for r in rows.select(ids.event_id(F.col("x"), F.col("y"), F.col("z"), F.lit(1))).collect()} == {None}
    assert len({r[0] for r in rows.select(ids.payment_hash(F.col("x"), F.col("y"), F.col("z"))).collect()}) == 3


def test_a_hot_key_is_dealt_out(spark):
    """Nine events in ten have one type, and many subscriptions ask for it without a scope."""
    rnd = random.Random(2)
    rows = [(i, "new_lot" if i % 10 else "lot_updated", json.dumps({"category": rnd.choice("abc")})) for i in range(4000)]
    events = spark.createDataFrame(rows, "seq long, event_type string, payload string").repartition(4)
    asked = [(f"n{k}", ["new_lot"], {}, True) for k in range(40)] + [("c", ["new_lot", "lot_updated"], {"category": "a"}, True), ("two", ["new_lot"], {"category": "a", "account_alias": "x"}, True), ("off", ["new_lot"], {}, False)]
    subscriptions = spark.createDataFrame(asked, "consumer_name string, event_types array<string>, filters map<string,string>, active boolean")
    hot = consume.hot_keys(events, 300)
    ways = {(r.event_type, r._field, r._value): r._ways for r in hot.collect()}
    assert ways["new_lot", "", ""] == 12 and ways["lot_updated", "", ""] == 2 and len(ways) == 5
    assert consume.hot_keys(events, 300, 2).count() == 0  # no key has half of all rows
    conf = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "16"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        plain = consume.fan_out(events, subscriptions).select("consumer_name", "seq")
        dealt = consume.fan_out(events, subscriptions, hot)
        parts = sorted(r["count"] for r in dealt.groupBy(F.spark_partition_id()).count().collect())
        assert sorted(map(tuple, dealt.select("consumer_name", "seq").collect())) == sorted(map(tuple, plain.collect()))
        assert max(parts) <= 4 * parts[len(parts) // 2] and max(parts) < 0.4 * sum(parts)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_frames_hold_the_envelope(spark):
    rows = spark.createDataFrame([(7, "e", "new_lot", "1", AT, 1, '{"category":"é"}')], "seq long, event_id string, event_type string, aggregate_id string, occurred_at timestamp, schema_version int, payload string")
    frame = delivery.sse_frames(delivery.with_body(rows).withColumn("data", F.col("body"))).collect()[0].frame
    lines = frame.split("\n")
    assert lines[:2] == ["id: 7", "event: new_lot"] and lines[3:] == ["", ""]
    assert json.loads(lines[2].removeprefix("data: ")) == {"event_id": "e", "event_type": "new_lot", "aggregate_id": "1", "occurred_at": "2026-01-02T03:04:05+00:00", "seq": 7, "schema_version": 1, "category": "é"}


def test_few_accounts_and_feeds_are_no_hot_keys(spark):
    """However large the tables seem, rows aren't dealt by account or feed."""
    operations = spark.createDataFrame([(1, 7, "income", Decimal(1), None, False, 0, 1, "rub", "u", 0, "c")], "operation_id long, account_id long, operation_type string, amount decimal(18,2), counterparty_id long, is_hold boolean, hold_end_date long, item_id long, currency string, counterparty_username string, fee int, comment string")
    told = spark.createDataFrame([("market", 5, "x", 1, "{}")], "kind string, notification_id long, content_type string, created_at long, extra string")
    marks = lambda key, kind: spark.createDataFrame([], f"{key} {kind}, mark long")
    seen = lambda key: spark.createDataFrame([], f"{key} long, content_hash string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plans = [
            feeds.payment_job(operations, marks("account_id", "long"), seen("operation_id"), 1, F.timestamp_seconds(F.lit(0)))[0],
            feeds.notification_job(told, marks("kind", "string"), seen("notification_id"), 1)[0],
            feeds.with_alias(operations, spark.createDataFrame([(7, "a", True)], "account_id long, alias string, is_primary boolean")),
        ]
        for plan in [p._jdf.queryExecution().executedPlan().toString() for p in plans]:
            assert "SortMergeJoin [account_id" not in plan and not [x for x in plan.splitlines() if "SortMergeJoin [kind" in x and "LeftSemi" in x]
            assert "BroadcastHashJoin" in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_budget_keeps_columns_of_the_log(spark):
    """Without a join by event id: an id that comes twice gives its two rows."""
    rows = [("e1", "new_lot", "7", 3, '{"category":"a","price":"5.00"}'), ("e1", "new_lot", "7", 4, '{"category":"a","price":"4.00"}'), ("e3", "lot_updated", "9", 5, '{"category":"a","price":"1"}')]
    events = spark.createDataFrame(rows, "event_id string, event_type string, aggregate_id string, poll_epoch long, payload string")
    got = feeds.within_budget(events, "a", "5", ["poll_epoch"])
    assert sorted((r.item_id, r.price, r.poll_epoch) for r in got.collect()) == [(7, Decimal("4.00000000"), 4), (7, Decimal("5.00000000"), 3)]
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_views_read_files_of_their_types_alone(spark):
    rows = spark.createDataFrame([("new_lot", '{"category":"a"}'), ("lot_updated", '{"category":"b"}'), ("new_lot", None)], "event_type string, payload string")
    kept = log.stable(rows.select("payload", "event_type"), ["event_type"])
    assert kept.columns == ["payload", "event_type"] and sorted(map(str, kept.select("event_type", "payload").collect())) == sorted(map(str, rows.collect()))
    view = log.typed(kept, ["new_lot"])
    assert sorted((r.event_type, r.category or "") for r in view.collect()) == [("new_lot", ""), ("new_lot", "a")]
    names = {r[0].split("event_type=")[1].split("/")[0] for r in view.select(F.input_file_name()).collect()}
    plan = view._jdf.queryExecution().executedPlan().toString()
    assert names == {"new_lot"} and "PartitionFilters: [isnotnull(event_type" in plan
