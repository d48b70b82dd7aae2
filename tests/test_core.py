"""Small cases of each operator family, and whole histories against the poll-by-poll rule."""

import hashlib
import hmac
import json
import random
from datetime import datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tidelog.functions import ids, payload as pl
from tidelog.operators import consume, delivery, feeds, id_index, log, snapshots
from tidelog.plans.router import Router
from tidelog.streaming import jobs

LOT = "category string, item_id long, poll_epoch long, price decimal(18,2), content_hash string"


def test_event_ids(spark):
    rows = spark.createDataFrame([("item-1", "dispute_opened", "hash-1", 1), ("item-2", "lot_reserved", "hash-2", 1), ("item-42", "new_lot", "hash-lot", 1)], "a string, t string, h string, e int")
    got = [r[0] for r in rows.select(ids.event_id(F.col("a"), F.col("t"), F.col("h"), F.col("e"))).collect()]
    assert got == ["39a19f25-209e-5a1a-91f8-96c9080d8c7e", "e5768aca-bd6d-5697-898f-a1467ebecba6", "0668afcd-d637-582a-8833-33cb16ad4abe"]


def rule(polls, misses):
    """The poll-by-poll rule on {epoch: {item: (price, hash)}} of one category."""
    base, out, first = {}, [], True
    for epoch in sorted(polls):
        lots = polls[epoch]
        if first:
            base, first = {i: [*v, 0] for i, v in lots.items()}, False
            continue
        for i, (price, h) in lots.items():
            if i not in base:
                out.append((i, epoch, "new_lot"))
            elif price < base[i][0]:
                out.append((i, epoch, "price_dropped"))
            elif h != base[i][1]:
                out.append((i, epoch, "lot_updated"))
        after = {i: [*v, 0] for i, v in lots.items()}
        for i, (price, h, m) in base.items():
            if i not in lots:
                if m + 1 >= misses:
                    out.append((i, epoch, "lot_disappeared"))
                else:
                    after[i] = [price, h, m + 1]
        base = after
    return sorted(out)


@pytest.mark.parametrize("misses", [1, 3])
def test_history_is_the_poll_by_poll_rule(spark, misses):
    rnd = random.Random(misses)
    lots, polls, expected = [], [], []
    for c in range(40):
        epochs = sorted(rnd.sample(range(1, 60), 12))
        history = {e: {i: (rnd.choice([5, 6, 7]), rnd.choice("ab")) for i in range(4) if rnd.random() < 0.5} for e in epochs}
        polls += [(f"c{c}", e) for e in epochs]
        lots += [(f"c{c}", i, e, Decimal(p), h) for e, items in history.items() for i, (p, h) in items.items()]
        expected += [(f"c{c}", *x) for x in rule(history, misses)]
    got = snapshots.history_diff(spark.createDataFrame(lots, LOT), spark.createDataFrame(polls, "category string, poll_epoch long"), misses)
    assert sorted((r.category, r.item_id, r.poll_epoch, r.event_type) for r in got.collect()) == sorted(expected)


@pytest.mark.parametrize("misses", [1, 2, 3])
def test_history_in_steps_is_the_whole_history(spark, misses):
    """However many polls a step takes, empty polls and late categories included; a repeated step tells nothing."""
    rnd = random.Random(10 + misses)
    lots, polls = [], []
    for c in range(12):
        for e in sorted(rnd.sample(range(1, 40), 14))[3 * (c % 2) :]:
            polls.append((f"c{c}", e))
            lots += [(f"c{c}", i, e, Decimal(rnd.choice([5, 6, 7])), rnd.choice("ab")) for i in range(4) if rnd.random() < 0.45]
    schema = LOT.replace("(18,2)", "(20,8)")
    whole = snapshots.history_diff(spark.createDataFrame(lots, schema), spark.createDataFrame(polls, "category string, poll_epoch long"), misses)
    columns = ["category", "item_id", "n", "poll_epoch", "event_type", "old_price", "price", "content_hash"]
    expected = sorted(map(str, whole.select(columns).collect()))
    base, taken, got = [], {}, []
    for low, high in ((0, 1), (1, 9), (1, 9), (9, 17), (17, 18), (18, 40)):
        frame = lambda rows, ddl: spark.createDataFrame(rows, ddl)
        args = frame([r for r in lots if low <= r[2] < high], schema), frame([p for p in polls if low <= p[1] < high], "category string, poll_epoch long")
        events, after, polled = snapshots.history_step(*args, frame(base, snapshots.BASELINE), frame([(c, *v) for c, v in taken.items()], snapshots.POLLED), misses)
        got += map(str, events.select(columns).collect())
        new = {r.category: (r.n, r.poll_epoch) for r in polled.collect()}
        base = [r for r in base if r[0] not in new] + [tuple(r) for r in after.collect()]
        taken |= new
    assert sorted(got) == expected


def test_diff_branches(spark):
    base = spark.createDataFrame([("f", 1, Decimal(100), "100", 0), ("f", 2, Decimal(100), "v1", 0), ("f", 9, Decimal(1), "x", 2)], "category string, item_id long, price decimal(18,2), content_hash string, miss_count int")
    snap = spark.createDataFrame([("f", 1, Decimal(80), "80"), ("f", 2, Decimal(100), "v2"), ("f", 3, Decimal(5), "n")], "category string, item_id long, price decimal(18,2), content_hash string")
    got = {r.item_id: r.event_type for r in snapshots.diff(base, snap).collect()}
    assert got == {1: "price_dropped", 2: "lot_updated", 3: "new_lot", 9: None}
    after = {r.item_id: (r.miss_count, r.ripe) for r in snapshots.next_baseline(snapshots.diff(base, snap)).collect()}
    assert after[9] == (3, True) and after[1] == (0, False)


def test_hmac_and_canonical_json(spark):
    rows = spark.createDataFrame([("k", "body é"), ("x" * 80, "b"), (None, "b")], "secret string, body string")
    got = pl.with_pads(rows, "secret").select("secret", "body", pl.sign(F.col("body"), F.col("inner"), F.col("outer")).alias("s"), pl.verify(F.lit("sha256=0"), F.col("body"), F.col("inner"), F.col("outer")).alias("v")).collect()
    for r in got:
        assert r.s == "sha256=" + hmac.new((r.secret or "").encode(), r.body.encode(), hashlib.sha256).hexdigest() and not r.v
    one = spark.createDataFrame([('{"b":"é","seq":9}', "e", "t", "a", "w", 1, 1)], "p string, i string, t string, a string, o string, s long, v int")
    assert one.select(pl.canonical_json("p", "i", "t", "a", "o", "s", "v")).collect()[0][0] == json.dumps({"b": "é", "seq": 1, "event_id": "e", "event_type": "t", "aggregate_id": "a", "occurred_at": "w", "schema_version": 1}, sort_keys=True, separators=(",", ":"))


def test_notifications(spark):
    rows = [("market", 2, "market_dispute_opened", 1, '{"claim_id": 555, "item_id": 999}'), ("market", 1, "market_new_review", 1, "{}"), ("nomarket", 10, "forum_warn_issued", 1, "{}"), ("market", 4, "market_purchase_confirmed", 1, '{"item_id": 333}'), ("market", 5, "market_dispute_opened", 1, '{"claim_id": "not-a-number"}'), ("market", 6, "market_lot_reserved", 1, '{"item_id": null}')]
    got = {r.notification_id: r for r in feeds.notification_events(spark.createDataFrame(rows, "kind string, notification_id long, content_type string, created_at long, extra string")).collect()}
    assert (got[2].event_type, got[2].claim_id, got[2].item_id) == ("dispute_opened", 555, 999)
    assert got[1].event_type == "market_notification_received" and got[10].event_type == "forum_notification_received"
    assert got[4].buyer_id is None and got[4].item_id == 333
    assert got[5].rejected == "notification_extra_invalid:claim_id" and got[2].rejected is None
    assert got[6].item_id is None and got[6].aggregate_id == "notif:market:6"


EVENT = "event_id string, event_type string, schema_version int, aggregate_id string, occurred_at timestamp, content_hash string, payload string, poll_epoch long"


def event(i, kind="new_lot", payload='{"category":"steam"}'):
    return (f"e{i}", kind, 1, str(i), None, f"h{i}", payload, 1)


def test_append_twice_changes_nothing(spark, tmp_path):
    folder = f"file://{tmp_path}/log"
    events = spark.createDataFrame([event(i) for i in range(5)] + [event(3)], EVENT)
    log.commit(events, folder, 1, ["event_id"])
    log.commit(events, folder, 2, ["event_id"])
    log.commit(spark.createDataFrame([event(7)], EVENT), folder, 3, ["event_id"])
    assert sorted((r.seq, r.event_id) for r in log.read(spark, folder).collect()) == [(1, "e0"), (2, "e1"), (3, "e2"), (4, "e3"), (5, "e4"), (6, "e7")]
    pages = log.pages(log.read(spark, folder), 0, 2).orderBy("page").collect()
    assert [r.n_events for r in pages] == [2, 2, 2] and pages[-1].next_seq == 6


def test_an_id_is_appended_once_whatever_its_epoch(spark, tmp_path):
    """The same id with another epoch, a null epoch or another payload gives no row, within a run and after it."""
    folder = f"file://{tmp_path}/log"
    other = lambda i, epoch: (f"e{i}", "new_lot", 1, "x", datetime(2027, 1, 1), "other", '{"a":1}', epoch)
    log.commit(spark.createDataFrame([event(1), event(2)], EVENT), folder, 1, ["event_id"])
    log.commit(spark.createDataFrame([other(1, 2), other(2, None), other(3, None), other(3, 7), event(4)], EVENT), folder, 2, ["event_id", "poll_epoch"])
    log.compact_index(spark, folder)
    log.commit(spark.createDataFrame([other(i, 9) for i in range(1, 6)], EVENT), folder, 3, ["event_id"])
    log.compact_index(spark, folder)
    log.commit(spark.createDataFrame([other(i, 10) for i in range(1, 7)], EVENT), folder, 4, ["event_id"])
    rows = sorted((r.seq, r.event_id, r.poll_epoch) for r in log.read(spark, folder).collect())
    assert rows == [(1, "e1", 1), (2, "e2", 1), (3, "e3", None), (4, "e4", 1), (5, "e5", 9), (6, "e6", 10)]


def test_the_id_index_reads_few_buckets(spark, tmp_path, monkeypatch):
    """All ids in the log are found; of new ones the filters let few pass; the plan names the buckets it reads."""
    folder = f"file://{tmp_path}/log"
    rows = spark.range(2000).select(*[F.lit(v).alias(c) if c != "event_id" else F.concat(F.lit("id-"), "id").alias(c) for c, v in zip([f.split()[0] for f in EVENT.split(", ")], event(1))])
    log.commit(rows, folder, 1, ["event_id"])
    committed = spark.createDataFrame([(r.run, r.attempt) for r in log._markers(spark, folder).collect()], "run long, attempt string")
    there = rows.select("event_id").where("event_id like '%7'")
    assert id_index.known(there, folder, committed).count() == there.count() == 200
    new = spark.range(1000).select(F.concat(F.lit("new-"), "id").alias("event_id"))
    assert id_index.known(new, folder, committed).count() == 0
    filters = spark.read.parquet(f"{folder}/filters")
    assert id_index.may_hold(new, filters).count() <= 2 and id_index.may_hold(there, filters).count() == 200
    found = id_index.known(there.limit(1), folder, committed)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(bucket," in plan or "In(bucket, [" in plan
    assert id_index.known(there, folder, committed.limit(0)).count() == 0


def test_a_repeated_or_crashed_run_loses_nothing(spark, tmp_path, monkeypatch):
    folder = f"file://{tmp_path}/log"
    rows = spark.createDataFrame([event(i) for i in range(5)], EVENT)
    log.commit(rows, folder, 1, ["event_id"])
    log.commit(rows, folder, 1, ["event_id"])
    assert log.read(spark, folder).count() == 5

    def crash(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:  # after the events, before the marker
        m.setattr(log, "_mark", crash)
        with pytest.raises(RuntimeError):
            log.commit(spark.createDataFrame([event(8)], EVENT), folder, 2, ["event_id"], rows.limit(1))
    assert log.read(spark, folder).count() == 5 and log.read_baseline(spark, folder, EVENT).count() == 0
    log.commit(spark.createDataFrame([event(8), event(9)], EVENT), folder, 2, ["event_id"], rows.limit(1))
    assert sorted((r.seq, r.event_id) for r in log.read(spark, folder).collect())[5:] == [(6, "e8"), (7, "e9")]
    assert log.read_baseline(spark, folder, EVENT).count() == 1


def test_pruning_rewrites_affected_runs_and_keeps_the_head(spark, tmp_path):
    folder = f"file://{tmp_path}/log"
    at = lambda i, day: (f"e{i}", "new_lot", 1, str(i), datetime(2026, 1, day), f"h{i}", "{}", 1)
    log.commit(spark.createDataFrame([at(1, 1), at(2, 20)], EVENT), folder, 1, ["event_id"])
    log.commit(spark.createDataFrame([at(3, 21), at(4, 22)], EVENT), folder, 2, ["event_id"])
    cursors = spark.createDataFrame([("a", 3), ("b", 9)], "consumer_name string, last_seq long")
    now = F.lit(datetime(2026, 2, 15))
    assert log.rewrite_pruned(spark, folder, cursors, now, 1) == 1  # the age rule keeps 2 and 3
    assert sorted(r.seq for r in log.read(spark, folder).collect()) == [2, 3, 4]
    assert log.rewrite_pruned(spark, folder, cursors, F.lit(datetime(2026, 6, 1)), 1) == 2
    assert sorted(r.seq for r in log.read(spark, folder).collect()) == [4]
    assert log.rewrite_pruned(spark, folder, cursors.withColumn("last_seq", F.lit(9)), F.lit(datetime(2026, 6, 1)), 1) == 1
    log.commit(spark.createDataFrame([at(5, 1)], EVENT), folder, 3, ["event_id"])
    assert [(r.seq, r.event_id) for r in log.read(spark, folder).collect()] == [(5, "e5")]
    log.compact_index(spark, folder)
    log.commit(spark.createDataFrame([at(5, 2), at(3, 1)], EVENT), folder, 4, ["event_id"])  # what was pruned may come again
    assert sorted((r.seq, r.event_id) for r in log.read(spark, folder).collect()) == [(5, "e5"), (6, "e3")]
    assert log.rewrite_pruned(spark, folder, cursors, now, 1) == 0


def test_ids_that_stay_after_pruning_are_known(spark, tmp_path):
    folder = f"file://{tmp_path}/log"
    at = lambda i, day: (f"e{i}", "new_lot", 1, str(i), datetime(2026, 1, day), f"h{i}", "{}", 1)
    log.commit(spark.createDataFrame([at(1, 1), at(2, 20)], EVENT), folder, 1, ["event_id"])
    cursors = spark.createDataFrame([("a", 3)], "consumer_name string, last_seq long")
    assert log.rewrite_pruned(spark, folder, cursors, F.lit(datetime(2026, 2, 10)), 1) == 1
    log.commit(spark.createDataFrame([at(2, 1), at(1, 1)], EVENT), folder, 2, ["event_id"])
    assert sorted((r.seq, r.event_id) for r in log.read(spark, folder).collect()) == [(2, "e2"), (3, "e1")]


def test_no_threshold_before_the_purchase(spark):
    end = datetime(2026, 1, 2)
    watched = spark.createDataFrame([(1, end, end - timedelta(hours=3))], "item_id long, guarantee_end timestamp, watched_from timestamp")
    ticks = spark.createDataFrame([(end - timedelta(hours=h),) for h in (20, 5, 2)], "tick timestamp")
    assert [(r.tick, r.label) for r in feeds.threshold_crossings(watched, ticks).collect()] == [(end - timedelta(hours=2), "6h")]


def test_dead_letters_can_be_decoded_again(spark):
    rows = spark.createDataFrame([("new_lot", "7", datetime(2026, 1, 1, 5), "h", 2, '{"a":1}')], "event_type string, aggregate_id string, occurred_at timestamp, content_hash string, schema_version int, payload string")
    packed = rows.select(pl.pack_dead_letter(*[F.col(c) for c in rows.columns]).alias("p"))
    assert json.loads(packed.collect()[0].p)["_meta"].keys() == {"event_type", "aggregate_id", "occurred_at", "content_hash", "schema_version"}
    assert packed.select(*pl.unpack_dead_letter(F.col("p"))).collect() == rows.collect()


def test_fan_out_by_scope_is_the_match_of_each_pair(spark):
    rnd = random.Random(1)
    logged = [(k, rnd.choice(["new_lot", "rating_changed"]), json.dumps({x: rnd.choice(["a", "b", "1"]) for x in ("category", "account_alias", "other") if rnd.random() < 0.6})) for k in range(60)] + [(99, "new_lot", None), (98, "new_lot", "no json")]
    asked = [(f"s{k}", rnd.sample(["new_lot", "rating_changed", "x"], 2), {x: rnd.choice("ab1") for x in ("category", "account_alias", "other") if rnd.random() < 0.4}, k % 7 != 0) for k in range(40)]
    rows = spark.createDataFrame(logged, "seq long, event_type string, payload string")
    sub = spark.createDataFrame(asked, "consumer_name string, event_types array<string>, filters map<string,string>, active boolean")
    parsed = lambda p: json.loads(p) if p and p[0] == "{" else {}
    expected = sorted((n, k) for n, types, f, on in asked for k, t, p in logged if on and t in types and all(parsed(p).get(x) == v for x, v in f.items()))
    assert sorted((r.consumer_name, r.seq) for r in consume.fan_out(rows, sub).collect()) == expected


def test_peek_and_confirm(spark):
    rows = spark.createDataFrame([(1, "new_lot", "{}"), (2, "price_dropped", "{}"), (3, "new_lot", "{}")], "seq long, event_type string, payload string")
    sub = spark.createDataFrame([("s", ["new_lot"], {}, True)], "consumer_name string, event_types array<string>, filters map<string,string>, active boolean")
    cursors = spark.createDataFrame([("s", 1)], "consumer_name string, last_seq long")
    r = consume.peek(rows, sub, cursors, 100).collect()[0]
    assert (r.n_items, r.next_seq, r.drained) == (1, 3, True)
    moved = consume.confirmed_reads(cursors, spark.createDataFrame([("s", 3), ("s", 1)], "consumer_name string, up_to_seq long"))
    assert moved.collect()[0].last_seq == 3


def test_outcomes(spark):
    rows = [("a", 1, 1, 500, None, None), ("a", 1, 2, 200, True, None), ("a", 2, 1, 400, None, None), ("a", 3, 1, None, None, "timeout"), ("a", 3, 2, 503, None, None), ("a", 3, 3, 429, None, None), ("a", 4, 1, 200, False, None), ("a", 5, 1, None, None, "unsafe_url:private")]
    got = {r.seq: (r.outcome, r.reason) for r in delivery.outcomes(spark.createDataFrame(rows, "consumer_name string, seq long, attempt long, status int, ok boolean, error string"), 3).collect()}
    assert got == {1: ("delivered", None), 2: ("dead", "http_400"), 3: ("dead", "http_429"), 4: ("pending", None), 5: ("dead", "unsafe_url:private")}


def test_poison_is_parked_and_the_rest_goes_on(spark):
    parked, done = [], []
    handler = lambda df: df.withColumn("error", F.when(F.col("seq") == 2, "boom"))
    run = jobs.handled(handler, lambda df: parked.extend(r.seq for r in df.collect()), lambda df: done.extend(r.seq for r in df.collect()), 2)
    run(spark.createDataFrame([(1, "a", "{}"), (2, "b", "{}"), (3, "c", "{}")], "seq long, event_id string, payload string"), 0)
    assert parked == [2] and sorted(done) == [1, 3]


def test_router_needs_types():
    with pytest.raises(ValueError):
        Router().on()


def test_consumer_stream_and_streamed_dedup(spark, tmp_path):
    rows = spark.createDataFrame([(k, f"e{k % 4}", "new_lot" if k % 2 else "lot_updated", '{"category":"steam"}' if k % 3 else "{}") for k in range(12)], "seq long, event_id string, event_type string, payload string")
    rows = rows.withColumn("occurred_at", F.timestamp_seconds(F.col("seq") * 60))
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    source = lambda: spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    run = lambda df, name: df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start().awaitTermination(120)
    assert run(jobs.subscribed(source(), ["new_lot"], {"category": "steam"}, 2), "tail") and run(jobs.deduplicated(source()), "once")
    assert sorted(r.seq for r in spark.table("tail").collect()) == [5, 7, 11]
    assert sorted(r.event_id for r in spark.table("once").collect()) == ["e0", "e1", "e2", "e3"]


PAYMENT = (
    "account_id long, operation_id long, operation_type string, amount decimal(18,2), counterparty_id long, is_hold boolean, hold_end_date long, item_id long,"
    " currency string, counterparty_username string, fee int, comment string"
)


def test_payment_job(spark):
    kind = next(iter(feeds.PAYMENT_EVENTS))
    row = lambda account, op, type_=kind, amount="1.50": (account, op, type_, Decimal(amount), None, False, 0, None, "rub", None, 0, None)
    first = spark.createDataFrame([row(1, 5), row(1, 6), row(1, 6), row(1, 7, "no such type"), row(2, 1)], PAYMENT)
    marks = spark.createDataFrame([(1, 5), (3, 9)], "account_id long, mark long")
    nothing = spark.createDataFrame([], "operation_id long, content_hash string")
    at = F.timestamp_seconds(F.lit(0))
    events, seen, after = feeds.payment_job(first, marks, nothing, 1, at)
    got = events.collect()
    assert sorted(r.operation_id for r in got) == [1, 6] and {r.event_type for r in got} == {feeds.PAYMENT_EVENTS[kind]}
    assert json.loads(got[0].payload)["amount"] == "1.50" and log.one_log(events).count() == 2
    assert sorted(r.operation_id for r in seen.collect()) == [1, 6, 7]
    assert {tuple(r) for r in after.collect()} == {(1, 7), (2, 1), (3, 9)}
    # the same poll again, before its marks are kept: only a changed amount passes
    again = first.union(spark.createDataFrame([row(1, 6, amount="2.50")], PAYMENT))
    assert [(r.operation_id, json.loads(r.payload)["amount"]) for r in feeds.payment_job(again, marks, seen, 2, at)[0].collect()] == [(6, "2.50")]
    # and with its marks, nothing
    assert feeds.payment_job(again, after, nothing, 2, at)[0].count() == 0
    assert feeds.payment_job(first.limit(0), marks, nothing, 1, at)[2].count() == 2


def test_retries_are_classified_once(spark):
    """No filter or join takes the classification down to the tables that attempts are made of."""
    from tidelog.sources import domain

    rows = delivery.retry_schedule(domain.load(spark, "/root/testdata/sf0.001", "attempts").where("attempt <= 4"), 2.0, 10.0, 20.0, 4)
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if ("Filter" in line or "Join" in line) and len(line) > 2000]
    assert {r[0] for r in rows.select("result").distinct().collect()} == {"retry"}


def test_pads_of_any_key(spark):
    """Keys with every byte, as short and as long as a block, longer, empty and null; words of eight bytes, not digits."""
    keys = ["", None, "k", "\x00\x7f", "é" * 32, "x" * 64, "y" * 65, "".join(map(chr, range(1, 64))), "ÿ" * 20]
    rows = pl.with_pads(spark.createDataFrame([(k,) for k in keys], "secret string"), "secret").withColumn("signed", pl.sign(F.lit("body é"), F.col("inner"), F.col("outer")))
    for r in rows.collect():
        assert r.signed == "sha256=" + hmac.new((r.secret or "").encode(), "body é".encode(), hashlib.sha256).hexdigest()
    assert "translate" not in rows._jdf.queryExecution().optimizedPlan().toString()


def test_polls_of_items_need_no_exchange_after_a_join_by_item(spark):
    """The last row by position in each poll, null polls too; a join by item_id has dealt the rows already."""
    rnd = random.Random(4)
    rows = [(rnd.choice("ab"), rnd.randint(1, 4), rnd.choice([None, 1, 2, 5]), rnd.randint(0, 5), rnd.randint(0, 10**6)) for _ in range(200)]
    rows = spark.createDataFrame(rows, "category string, item_id long, poll_epoch long, page int, place long")
    want = snapshots.last_wins(rows, [*snapshots.KEY, "poll_epoch"], ["page", "place"])
    got = snapshots.latest_per_poll(rows, ["page", "place"])
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.count() == rows.select(*snapshots.KEY, "poll_epoch").distinct().count()
    items = spark.createDataFrame([(i, i) for i in range(5)], "item_id long, weight long")
    joined = snapshots.latest_per_poll(rows.hint("merge").join(items, "item_id"), ["page", "place"])
    assert joined._jdf.queryExecution().sparkPlan().toString().count("Exchange") == 0
    assert joined._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 2
