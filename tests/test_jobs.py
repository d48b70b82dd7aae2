"""Jobs on the log end to end: polls into it, consumers from it, restarts in the middle."""

import json
import random
import time
from datetime import datetime, timedelta

import duckdb
import pytest
from pyspark.sql import functions as F

from tidelog.operators import consume, id_index, log, snapshots
from tidelog.plans import queries, streams
from tidelog.sources import pages
from tidelog.streaming import consumers
from tidelog.streaming.polls import polls_to_log

START = datetime(2026, 1, 1)
EVENT = "event_id string, event_type string, schema_version int, aggregate_id string, occurred_at timestamp, content_hash string, payload string, poll_epoch long"
SUBSCRIPTION = "consumer_name string, event_types array<string>, filters map<string,string>, active boolean"


def page(category, poll, number, items):
    lots = [{"item_id": i, "title": title, "price": price, "currency": "rub", "seller_id": 1, "other": 1} for i, price, title in items]
    return json.dumps({"category": category, "captured_at": (START + poll * timedelta(hours=1)).isoformat(), "page": number, "per_page": 2, "items": lots, "unknown": [1]})


def run_stream(spark, folder, states, rejected):
    stream = pages.stream_pages(spark, f"{folder}/pages").writeStream.foreachBatch(polls_to_log(f"{folder}/log", states, misses=2, rejected=rejected))
    return stream.option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()


def test_polls_reach_the_log_once_through_a_crash(spark, tmp_path, monkeypatch):
    """Three files: two polls with a lot that stands on two pages, an empty poll with a broken line, a poll of two
    categories. The second batch dies between its events and its marker, and the query starts again."""
    folder = f"file://{tmp_path}"
    files = [
        [page("a", 1, 1, [(1, 10, "x"), (2, 5, "y")]), page("a", 1, 2, [(1, 9, "x")]), page("a", 2, 1, [(1, 9, "z"), (2, 4, "y"), (3, 1, "n")])],
        [page("a", 3, 1, []), '{"category":"broken'],
        [page("a", 4, 1, [(1, 9, "z")]), page("b", 4, 1, [(1, 1, "b")]), page("a", 2, 1, [(8, 1, "too late")])],
    ]
    states = spark.createDataFrame([(2, "sold")], "item_id long, item_state string")
    seen = []
    rejected = lambda rows, batch: seen.extend((batch, r[0]) for r in rows.collect())
    marked = log._mark
    for k, lines in enumerate(files):
        spark.createDataFrame([("\n".join(lines),)], "value string").coalesce(1).write.mode("append").text(f"{folder}/pages")
        if k == 1:
            with monkeypatch.context() as m:
                m.setattr(log, "_mark", lambda *_: 1 / 0)
                with pytest.raises(Exception, match="division by zero"):
                    run_stream(spark, folder, states, rejected).awaitTermination()
            assert log._mark is marked
        run_stream(spark, folder, states, rejected).awaitTermination()
    run_stream(spark, folder, states, rejected).awaitTermination()
    rows = sorted((r.seq, r.aggregate_id, r.event_type, r.poll_epoch, json.loads(r.payload)) for r in log.read(spark, f"{folder}/log").collect())
    assert [r[0] for r in rows] == list(range(1, len(rows) + 1))
    assert [(r[1], r[2], r[3]) for r in rows] == [
        ("a", "snapshot_initialized", 1), ("1", "lot_updated", 2), ("2", "price_dropped", 2), ("3", "new_lot", 2),
        ("b", "snapshot_initialized", 1), ("2", "lot_disappeared", 4), ("3", "lot_disappeared", 4),
    ]
    assert rows[0][4] == {"category": "a", "lot_count": 2} and rows[2][4]["old_price"] == "5.00000000" and rows[2][4]["price"] == "4.00000000"
    assert [r[4].get("reason") for r in rows[-2:]] == ["sold", "unknown"]
    assert {x for x in seen} == {(1, '{"category":"broken')}
    held = log.read_state(spark, f"{folder}/log", "baseline", snapshots.BASELINE, [2]).collect()
    assert sorted((r.category, r.item_id, r.miss_count) for r in held) == [("a", 1, 0), ("b", 1, 0)]


def test_passing_tables_leave_nothing_behind(spark, tmp_path):
    """A table of two equal megabytes is written once, packed; a batch of polls leaves its log only."""
    kept = spark.sparkContext.getCheckpointDir()
    spark.sparkContext.setCheckpointDir(f"file://{tmp_path}/checkpoints")
    try:
        size = lambda: sum(f.stat().st_size for f in (tmp_path / "checkpoints").rglob("*") if f.is_file())
        runs = spark.sparkContext.accumulator(0)

        def seen(parts):
            for part in parts:
                runs.add(len(part))
                yield part

        rows = log.stable(spark.range(20_000).select("id", F.lit("x" * 100).alias("text")).mapInPandas(seen, "id long, text string"))
        assert rows.count() == 20_000 and runs.value == 20_000 and 0 < size() < 500_000
        before, folder = size(), f"file://{tmp_path}/polls"
        spark.createDataFrame([(page("a", 1, 1, [(1, 10, "x")]),), (page("a", 2, 1, [(2, 10, "x")]),)], "value string").coalesce(1).write.text(f"{folder}/pages")
        run_stream(spark, folder, spark.createDataFrame([], "item_id long, item_state string"), None).awaitTermination()
        assert log.read(spark, f"{folder}/log").count() == 2 and size() == before
    finally:
        if kept is not None:
            spark.sparkContext.setCheckpointDir(kept.rsplit("/", 1)[0])


def exchanges(rows):
    return [line.strip(" +-:") for line in rows._jdf.queryExecution().executedPlan().toString().splitlines() if line.strip(" +-:").startswith("Exchange ")]


def test_exchanged_rows_go_with_their_job(spark, tmp_path):
    """Not when the driver collects garbage, and only while tables pass."""
    files = lambda: spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().size()
    setting = lambda: spark.conf.get(log._EXCHANGED, None)
    before, kept = files(), setting()
    log.commit(spark.createDataFrame(events(1, 40), EVENT).repartition(4), f"file://{tmp_path}/log", 0, ["event_id"])
    for _ in range(100):
        if files() <= before:
            break
        time.sleep(0.1)
    assert files() <= before and setting() == kept


def test_new_events_are_found_without_dealing_them(spark, tmp_path):
    """Ids that come twice, that the log has, that are null: as new_events, but only repeated ids are exchanged."""
    rnd = random.Random(5)
    rows = [(rnd.choice([None, *(f"e{i}" for i in range(300))]), k) for k in range(200)]
    spark.createDataFrame(rows, "event_id string, place long").write.parquet(f"file://{tmp_path}/rows")
    made = spark.read.parquet(f"file://{tmp_path}/rows")
    known = spark.createDataFrame([(f"e{i}",) for i in range(0, 400, 7)], "event_id string")
    with log.passing(spark):
        got = log.unseen(made, known, ["place"])
        assert sorted(map(str, got.collect())) == sorted(map(str, log.new_events(made, known, ["place"]).collect())) and got.count() > 50
        # one exchange, of what the join with the repeated ids leaves
        plan = log.unseen(made, known, ["place"])
        assert len(exchanges(plan)) == 1 and "LeftSemi, BuildRight" in plan._jdf.queryExecution().executedPlan().toString().split("Exchange hash")[1]
    for words in (id_index.filter_words(made), id_index.filter_words(made, "place")):
        assert len(exchanges(words)) == 1


def test_lots_are_dealt_once_a_step(spark):
    """The last row of an item in a poll and its history come from one exchange by item, with the baseline's rows."""
    rnd = random.Random(6)
    rows = [("ab"[rnd.randint(0, 1)], rnd.randint(1, 4), rnd.randint(4, 9), rnd.randint(1, 2), rnd.randint(0, 10**6), rnd.randint(1, 3), rnd.choice("xy")) for _ in range(150)]
    lots = spark.createDataFrame(rows, "category string, item_id long, poll_epoch long, page int, place long, price int, content_hash string")
    polls = lots.select("category", "poll_epoch").distinct()
    base = spark.createDataFrame([(c, i, 2, "x", i % 3) for c in "ab" for i in range(2, 7)], "category string, item_id long, price int, content_hash string, miss_count int")
    base = base.withColumn("price", F.col("price").cast("decimal(20,8)"))
    polled = spark.createDataFrame([("a", 3, 3), ("b", 5, 4)], snapshots.POLLED)
    want = snapshots.history_step(snapshots.last_wins(lots, [*snapshots.KEY, "poll_epoch"], ["page", "place"]), polls, base, polled)
    got = snapshots.history_step(lots, polls, base, polled, position=["page", "place"])
    for g, w in zip(got, want):
        assert sorted(map(str, g.collect())) == sorted(map(str, w.collect())) and g.count()
    plan = snapshots.history_step(lots, polls, base, polled, position=["page", "place"])[1]
    assert sum("item_id" in e for e in exchanges(plan)) == 1


def test_parts_in_turn_are_even_and_bounded(spark):
    rnd = random.Random(7)
    rows = [(t, rnd.choice([0, 1, 2, 50 if t == 5 else 3])) for t in range(40) for _ in range(5)] + [(None, 9)]
    frame = spark.createDataFrame(rows, "at long, n int")
    whole = sum(n for t, n in rows if t is not None)
    for most in (10**6, 20):
        parts = [[(r.at, r.n) for r in p.collect()] for p in streams.in_turn(frame, "at", F.col("n"), most)]
        assert sorted(x for p in parts for x in p) == sorted(x for x in rows if x[0] is not None)
        assert all(max(a)[0] < min(b)[0] for a, b in zip(parts, parts[1:]))
        width, one = min(most, whole // 2 + 5), max(sum(n for u, n in rows if u == t) for t in range(40))
        assert all(sum(n for _, n in p) < width + one for p in parts)
        assert len(parts) == 2 if most > whole else len(parts) > 4
    assert streams.in_turn(frame.limit(0), "at", F.col("n"), 5) == []


def test_polls_in_more_batches_give_the_same_log(spark, monkeypatch):
    """Batches of a bounded number of lots; the page files of those before are gone."""
    monkeypatch.setattr(queries, "LOTS_A_BATCH", 1500)
    data, folders, shared_folder = "/root/testdata/sf0.001", [], streams.shared_folder
    monkeypatch.setattr(streams, "shared_folder", lambda *args: folders.append(shared_folder(*args)) or folders[0])
    got = queries.QUERIES["ss1_polls_to_log"](spark, data)
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for table in ("lineitem", "part"):
        con.execute(f"create view {table} as select * from '{data}/{table}.parquet'")
    assert sorted(map(tuple, got.collect())) == sorted(con.execute(queries.ORACLES["ss1_polls_to_log"]).fetchall())
    assert log._markers(spark, f"{folders[0]}/log").count() >= 4 and not id_index.exists(spark, f"{folders[0]}/recorded")
    assert spark.read.text(f"{folders[0]}/pages").select(F.input_file_name()).distinct().count() < 10
    assert len({r[0].split("slice=")[1][0] for r in spark.read.text(f"{folders[0]}/pages").select(F.input_file_name()).collect()}) == 1


def test_page_and_feed_files(spark, tmp_path):
    """Malformed files and lines are set apart with their file; unknown fields are ignored; the category of the envelope fills in."""
    (tmp_path / "one.json").write_text(json.dumps(json.loads(page("a", 1, 1, [(1, 10.5, "x"), (2, 5, "é")])), indent=1))
    (tmp_path / "two.json").write_text("{ broken")
    (tmp_path / "three.json").write_text(json.dumps({"category": "a", "page": 1}))
    good, rejected = pages.read_pages(spark, f"file://{tmp_path}", multiline=True)
    lots = sorted((r.category, r.item_id, str(r.price), r.title, r.place) for r in pages.lots_of(good).collect())
    assert lots == [("a", 1, "10.50000000", "x", 0), ("a", 2, "5.00000000", "é", 1)]
    assert sorted(r.file for r in rejected.collect()) == ["three.json", "two.json"] and good.select("file").collect()[0][0] == "one.json"
    (tmp_path / "feed").mkdir()
    (tmp_path / "feed" / "a.jsonl").write_text('{"user_id":1,"user_like_count":3,"x":{}}\n[1\n{"username":"no id"}\n{"user_id":"seven"}\n')
    rows, bad = pages.read_feed(spark, f"file://{tmp_path}/feed", "user_id long, username string, user_like_count int")
    assert [(r.user_id, r.user_like_count) for r in rows.collect()] == [(1, 3)] and bad.count() == 3
    hashes = {r[0] for r in spark.createDataFrame([("x", "rub", 1, 5), ("x", "rub", 1, 9), ("y", "rub", 1, 5), (None, "rub", 1, 5), ("", "rub", 1, 5)], "title string, currency string, seller_id long, price int").select(pages.lot_hash()).collect()}
    assert len(hashes) == 4  # the price is no part of it; no title is not an empty one


def events(first, last):
    kind = lambda i: "new_lot" if i % 3 else "lot_updated"
    return [(f"e{i:03d}", kind(i), 1, str(i), START, f"h{i}", json.dumps({"category": "ab"[i % 2]}), 1) for i in range(first, last + 1)]


def test_consumers_catch_up_in_order_through_a_crash(spark, tmp_path, monkeypatch):
    folder, cursors = f"file://{tmp_path}/log", f"file://{tmp_path}/consumers"
    subscriptions = spark.createDataFrame([("all", ["new_lot", "lot_updated"], {}, True), ("a", ["new_lot"], {"category": "a"}, True), ("off", ["new_lot"], {}, False)], SUBSCRIPTION)
    consumers.advance(spark, cursors, 0, spark.createDataFrame([("a", 4), ("off", 3)], consumers.CURSORS))
    with pytest.raises(consumers.Lost):
        consumers.advance(spark, cursors, 0, spark.createDataFrame([("a", 100)], consumers.CURSORS))
    assert {r.consumer_name: r.last_seq for r in consumers.read_cursors(spark, cursors)[1].collect()} == {"a": 4, "off": 3}

    def wake():
        stream = consumers.new_heads(spark, folder).writeStream.foreachBatch(consumers.catch_up(folder, cursors, lambda: subscriptions))
        stream.option("checkpointLocation", f"file://{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()

    log.commit(spark.createDataFrame(events(1, 6), EVENT), folder, 0, ["event_id"])
    wake()
    log.commit(spark.createDataFrame(events(7, 9), EVENT), folder, 1, ["event_id"])
    spark.createDataFrame([(99, *events(99, 99)[0])], "seq long, " + EVENT).write.parquet(f"{folder}/events/run=5/attempt=dead")  # of a run that was never committed
    with monkeypatch.context() as m:  # delivered, but nobody is told
        m.setattr(consumers, "_claim", lambda *_: 1 / 0)
        with pytest.raises(Exception, match="division by zero"):
            wake()
    log.commit(spark.createDataFrame(events(10, 12), EVENT), folder, 2, ["event_id"])
    wake()
    wake()
    got = [(r.consumer_name, r.version, r.seq) for r in consumers.delivered(spark, cursors, consumers.DELIVERY).orderBy("consumer_name", "version", "seq").collect()]
    assert [s for c, _, s in got if c == "all"] == list(range(1, 13)) and not [c for c in got if c[0] == "off"]
    assert [s for c, _, s in got if c == "a"] == [s for s in range(5, 13) if s % 3 and s % 2 == 0]
    assert {r.consumer_name: r.last_seq for r in consumers.read_cursors(spark, cursors)[1].collect()} == {"a": 12, "all": 12, "off": 3}
    assert consumers.read_cursors(spark, cursors)[0] == 4


def test_peek_is_the_scan_of_each_cursor(spark):
    """A log with gaps; cursors at, between, below and above its numbers; several at one place."""
    rnd = random.Random(3)
    numbers = sorted(rnd.sample(range(1, 5000), 700))
    rows = spark.createDataFrame([(n, "new_lot" if n % 2 else "lot_updated", json.dumps({"category": "ab"[n % 3 == 0]})) for n in numbers], "seq long, event_type string, payload string").repartition(3)
    places = {f"c{k}": p for k, p in enumerate([0, 0, numbers[0], numbers[-1], 9999, *rnd.sample(range(5000), 30), numbers[300], numbers[300]])}
    cursors = spark.createDataFrame(list(places.items()), "consumer_name string, last_seq long")
    asked = spark.createDataFrame([(c, ["new_lot"], {"category": "a"}, True) for c in [*places, "without"]] + [("off", ["new_lot"], {}, False)], SUBSCRIPTION)
    found = consume.peek(rows, asked, cursors, 40)
    got = {r.consumer_name: (r.last_read_seq, r.n_items, r.next_seq, r.drained) for r in found.collect()}
    for name, at in {**places, "without": 0}.items():
        window = [n for n in numbers if n > at][:40]
        assert got[name] == (at, sum(n % 2 == 1 and n % 3 != 0 for n in window), window[-1] if window else at, len(window) < 40)
    assert len(got) == len(places) + 1
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert consume.peek(rows.limit(0), asked, cursors, 40).where("drained and next_seq = last_read_seq").count() == len(got)
    assert consume.peek(rows, asked.limit(0), cursors, 40).count() == 0


def test_deliveries_are_made_once(spark, tmp_path, monkeypatch):
    """Ranging them by consumer and number reads them twice, so they are written before."""
    folder, cursors, made = f"file://{tmp_path}/log", f"file://{tmp_path}/consumers", spark.sparkContext.accumulator(0)
    subscriptions = spark.createDataFrame([("all", ["new_lot", "lot_updated"], {}, True)], SUBSCRIPTION)
    log.commit(spark.createDataFrame(events(1, 6), EVENT), folder, 0, ["event_id"])
    catch_up = consume.catch_up

    def counted(*tables):
        def seen(parts):
            for part in parts:
                made.add(len(part))
                yield part

        rows = catch_up(*tables).select("consumer_name", "seq", "event_id", "event_type", "payload")
        return rows.mapInPandas(seen, rows.schema)

    monkeypatch.setattr(consume, "catch_up", counted)
    consumers.catch_up(folder, cursors, lambda: subscriptions)(spark.createDataFrame([(6,)], "head long"), 0)
    assert [r.seq for r in consumers.delivered(spark, cursors, consumers.DELIVERY).orderBy("seq").collect()] == [1, 2, 3, 4, 5, 6] and made.value == 6
