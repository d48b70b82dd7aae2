"""One query per operator, over domain tables of the driver's data, with DuckDB SQL for each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import BooleanType, StringType, StructType, TimestampType

from tidelog.functions import ids, payload as pl
from tidelog.operators import consume, delivery, feeds, log, snapshots
from tidelog.plans import streams
from tidelog.plans.router import Router, collect_sources
from tidelog.schemas import EVENT_COLUMNS, EVENT_TYPES, NOTIFICATION, PAYLOADS
from tidelog.sources.domain import duckdb_sql, load
from tidelog.sources.pages import lots_of, parsed_invoices, read_feed, read_pages, stream_pages
from tidelog.streaming import consumers, jobs
from tidelog.streaming.polls import lot_log_events, polls_to_log

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

UUID = """substr(d,1,8) || '-' || substr(d,9,4) || '-5' || substr(d,14,3) || '-' || translate(substr(d,17,1),'0123456789abcdef','89ab89ab89ab89ab') || substr(d,18,3) || '-' || substr(d,21,12)"""
SHA1 = "sha1(unhex('6f9619ff8b86d011b42d00cf4fc964ff') || encode({key}))"
POSITION = ["l_shipdate", "l_orderkey", "l_linenumber", "price", "l_suppkey"]
DAY_ZERO = 788918400

_LATEST = """obs as (select * from (select *, row_number() over (partition by category, item_id, poll_epoch order by l_shipdate desc, l_orderkey desc, l_linenumber desc, price desc, l_suppkey desc) k from {lot_observations}) where k = 1),
 nums as (select category, poll_epoch, row_number() over (partition by category order by poll_epoch) n, count(*) over (partition by category) last from {polls}),
 seen as (select o.category, o.item_id, n.n, n.last, o.price, o.content_hash, lag(n.n) over w pn, lag(o.price) over w pprice, lag(o.content_hash) over w phash, lead(n.n) over w nn
   from obs o join nums n using (category, poll_epoch) window w as (partition by o.category, o.item_id order by n.n)),
 made as (select category, item_id, case when pn is null or n - pn > 3 then 'new_lot' when price < pprice then 'price_dropped' else 'lot_updated' end event_type, n, case when pn is not null and n - pn <= 3 and price < pprice then pprice end old_price, price, content_hash
   from seen where (pn is null and n > 1) or n - pn > 3 or price < pprice or content_hash <> phash
   union all select category, item_id, 'lot_disappeared', n + 3, null, null, 'gone:' || item_id from seen where coalesce(nn - 1, last) - n >= 3),
 history as (select m.*, nums.poll_epoch from made m join nums on m.category = nums.category and m.n = nums.n)"""


def query(name: str, sql: str | None):
    """Registers a query; ``sql`` may name domain tables in curly brackets."""

    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = duckdb_sql(sql)
        return f

    return add


def lots_by_poll(s: SparkSession, d: str) -> DataFrame:
    return snapshots.latest_per_poll(load(s, d, "lot_observations"), POSITION)


def history(s: SparkSession, d: str) -> DataFrame:
    return snapshots.history_diff(lots_by_poll(s, d), log.stable(load(s, d, "polls")))


def lot_events(s: SparkSession, d: str) -> DataFrame:
    """The flagship: all lot events of the whole history as rows of the log, confirmed where gone."""
    # polls come from all lots, and are read several times
    polls = log.stable(load(s, d, "polls"))
    made = snapshots.confirmed_events(log.stable(snapshots.history_diff(lots_by_poll(s, d), polls)), load(s, d, "lot_states")).withColumn("aggregate_id", F.col("item_id").cast("string")).withColumn("lot_count", F.lit(None).cast("long"))
    marks = snapshots.bootstrap_markers(load(s, d, "lot_observations"), polls)
    marks = marks.select("*", F.col("category").alias("aggregate_id"), F.lit("snapshot_initialized").alias("event_type"), F.concat(F.lit("bootstrap:"), "lot_count").alias("content_hash"))
    both = made.drop("item_id", "n").unionByName(marks, allowMissingColumns=True)
    return lot_log_events(both, F.timestamp_seconds(F.lit(DAY_ZERO) + F.col("poll_epoch") * POLL_SECONDS))


POLL_SECONDS = 30 * 86400
_FIELD = lambda k: f"""coalesce(',"{k}":"' || {k} || '"', '')"""


@query("flagship_lot_events", f"""with {_LATEST}, marks as (select f.category aggregate_id, 'snapshot_initialized' event_type, count(distinct o.item_id) lot_count, f.poll_epoch, f.category
  from (select category, min(poll_epoch) poll_epoch from {{polls}} group by 1) f left join {{lot_observations}} o using (category, poll_epoch) group by all),
 gone as (select category, item_id, poll_epoch, row_number() over (partition by category, poll_epoch order by item_id) k from history where event_type = 'lot_disappeared'),
 why as (select category, item_id, poll_epoch, case when item_state is null or k > 5 then 'unknown' when item_state = 'closed' then 'delisted' when item_state in ('sold','paid','purchased') then 'sold' else 'unknown' end reason from gone left join {{lot_states}} using (item_id)),
 ev as (select cast(h.item_id as varchar) aggregate_id, h.event_type, h.content_hash, h.poll_epoch, '{{"category":"' || h.category || '"' || {_FIELD('price')} || {_FIELD('old_price')} || {_FIELD('reason')} || {_FIELD("confidence")} || '}}' payload
   from (select h.*, reason, case when reason = 'unknown' then 'low' when reason is not null then 'normal' end confidence from history h left join why on h.event_type = 'lot_disappeared' and h.category = why.category and h.item_id = why.item_id and h.poll_epoch = why.poll_epoch) h
   union all select aggregate_id, event_type, 'bootstrap:' || lot_count, poll_epoch, '{{"category":"' || category || '","lot_count":' || lot_count || '}}' from marks)
 select {UUID} event_id, event_type, 1 schema_version, aggregate_id, cast({DAY_ZERO} + poll_epoch * {POLL_SECONDS} as bigint) occurred_secs, content_hash, payload, poll_epoch from (select *, {SHA1.format(key="aggregate_id || '|' || event_type || '|' || content_hash || '|' || poll_epoch")} d from ev)""")
def _(s, d):
    return lot_events(s, d).withColumn("occurred_at", F.unix_seconds("occurred_at")).withColumnRenamed("occurred_at", "occurred_secs")


@query("wn1_last_wins", "select category, item_id, poll_epoch, price, content_hash from (select *, row_number() over (partition by category, item_id, poll_epoch order by l_shipdate desc, l_orderkey desc, l_linenumber desc, price desc, l_suppkey desc) k from {lot_observations}) where k = 1")
def _(s, d):
    return lots_by_poll(s, d).select("category", "item_id", "poll_epoch", "price", "content_hash")


@query("wn2_history_diff", f"with {_LATEST} select category, item_id, n, poll_epoch, event_type, old_price, price, content_hash from history")
def _(s, d):
    return history(s, d).select("category", "item_id", "n", "poll_epoch", "event_type", "old_price", "price", "content_hash")


_GONE = f"""{_LATEST}, gone as (select category, item_id, poll_epoch, row_number() over (partition by category, poll_epoch order by item_id) k from history where event_type = 'lot_disappeared')"""
_REASON = "case when item_state is null or k > 5 then 'unknown' when item_state = 'closed' then 'delisted' when item_state in ('sold','paid','purchased') then 'sold' else 'unknown' end"


@query("wn3_jn3_confirm", f"with {_GONE} select category, item_id, poll_epoch, {_REASON} reason, case when {_REASON} = 'unknown' then 'low' else 'normal' end confidence from gone left join {{lot_states}} using (item_id)")
def _(s, d):
    gone = history(s, d).where("event_type = 'lot_disappeared'").select("category", "item_id", "poll_epoch")
    return snapshots.confirmed(gone, load(s, d, "lot_states"))


@query("sc7_disappearance_reason", f"select item_id, {_REASON} reason, case when {_REASON} = 'unknown' then 'low' else 'normal' end confidence from (select p_partkey item_id, 1 k from {{part}}) left join {{lot_states}} using (item_id)")
def _(s, d):
    rows = load(s, d, "part").select(F.col("p_partkey").alias("item_id")).join(load(s, d, "lot_states"), "item_id", "left")
    return rows.withColumn("r", pl.resolve_reason(F.col("item_state"), F.col("item_state").isNotNull())).select("item_id", "r.reason", "r.confidence")


# the poll of month 25 against the baseline of all months before, misses counted by item id
_POLL = """snap as (select category, item_id, price, content_hash from (select *, row_number() over (partition by category, item_id order by l_shipdate desc, l_orderkey desc, l_linenumber desc, price desc, l_suppkey desc) k from {lot_observations} where mon = 25) where k = 1),
 base as (select category, item_id, price, content_hash, item_id % 3 miss_count from (select *, row_number() over (partition by category, item_id order by l_shipdate desc, l_orderkey desc, l_linenumber desc, price desc, l_suppkey desc) k from {lot_observations} where mon < 25) where k = 1)"""


def one_poll(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    obs = load(s, d, "lot_observations")
    keys = ["category", "item_id"]
    snap = snapshots.last_wins(obs.where("mon = 25"), keys, POSITION).select(*keys, "price", "content_hash")
    base = snapshots.last_wins(obs.where("mon < 25"), keys, POSITION).select(*keys, "price", "content_hash", (F.col("item_id") % 3).alias("miss_count"))
    return base, snap


@query("jn1_snapshot_diff", f"""with {_POLL} select category, item_id, s.item_id is not null present, case when s.item_id is null then null when b.item_id is null then 'new_lot' when s.price < b.price then 'price_dropped' when s.content_hash <> b.content_hash then 'lot_updated' end event_type, b.price old_price, s.price
 from base b full join snap s using (category, item_id)""")
def _(s, d):
    return snapshots.diff(*one_poll(s, d)).select("category", "item_id", "present", "event_type", "old_price", "price")


@query("jn2_next_baseline", f"""with {_POLL} select category, item_id, coalesce(s.price, b.price) price, coalesce(s.content_hash, b.content_hash) content_hash, case when s.item_id is not null then 0 else b.miss_count + 1 end miss_count from base b full join snap s using (category, item_id) where s.item_id is not null or b.miss_count + 1 < 3""")
def _(s, d):
    return snapshots.next_baseline(snapshots.diff(*one_poll(s, d))).where("not ripe").drop("ripe")


@query("st1_absent_ids", f"with {_POLL} select category, item_id from base except select category, item_id from snap")
def _(s, d):
    return snapshots.absent(*one_poll(s, d))


@query("jn4_batch_lookup", "select cast(i - 1 as int) pos, l.item_id, title from (select unnest(range(1, 21)) i) join {lots} l on l.item_id = i * 13")
def _(s, d):
    wanted = s.range(1).select(F.transform(F.sequence(F.lit(1), F.lit(20)), lambda i: (i * 13).cast("long")).alias("ids"))
    return snapshots.lookup(wanted, load(s, d, "lots")).select("pos", "item_id", "title")


@query("ag1_bootstrap", "select category, f.poll_epoch, count(distinct o.item_id) lot_count from (select category, min(poll_epoch) poll_epoch from {polls} group by 1) f left join {lot_observations} o using (category, poll_epoch) group by 1, 2")
def _(s, d):
    return snapshots.bootstrap_markers(load(s, d, "lot_observations"), load(s, d, "polls"))


@query("ag8_events_per_poll", f"with {_LATEST} select category, poll_epoch, event_type, count(*) n_events from history group by all")
def _(s, d):
    return snapshots.events_per_poll(history(s, d))


@query("fl5_catalog_filter", "select item_id, price, title, game from {lots} where category = 'small' and price >= 905 and price <= 1400 and game in ('Brand#11','Brand#12','Brand#13','Brand#21','Brand#22')")
def _(s, d):
    return snapshots.catalog(load(s, d, "lots"), "small", 905, 1400, None, ["Brand#11", "Brand#12", "Brand#13", "Brand#21", "Brand#22"]).select("item_id", "price", "title", "game")


@query("fl5_catalog_title", "select item_id, title from {lots} where category = 'large' and title like '%a%' and price >= 950")
def _(s, d):
    return snapshots.catalog(load(s, d, "lots"), "large", 950, None, "a").select("item_id", "title")


@query("fl7_deals", "select item_id, price, ai_price from {lots} where price < ai_price * 0.85")
def _(s, d):
    return snapshots.deals(load(s, d, "lots"), "0.85").select("item_id", "price", "ai_price")


@query("tk3_catalog_order", "select item_id, price from {lots} order by price desc, item_id limit 25")
def _(s, d):
    return snapshots.top_lots(load(s, d, "lots"), "price_to_down", 25).select("item_id", "price")


@query("tk3_newest_per_poll", "select category, poll_epoch, item_id, l_orderkey, l_linenumber from (select *, row_number() over (partition by category, poll_epoch order by l_shipdate desc, item_id, l_orderkey, l_linenumber, price, l_suppkey) k from {lot_observations}) where k <= 10")
def _(s, d):
    rows = load(s, d, "lot_observations")
    ranked = rows.withColumn("published_at", F.col("l_shipdate")).withColumn("id_", F.col("item_id")).withColumn("item_id", F.struct("item_id", "l_orderkey", "l_linenumber", "price", "l_suppkey"))
    return snapshots.newest_per_poll(ranked, 10).select("category", "poll_epoch", F.col("id_").alias("item_id"), "l_orderkey", "l_linenumber")


@query("io1_pages", "select category, item_id, price, cast((row_number() over (partition by category order by item_id) - 1) % 50 as int) place, cast(floor((row_number() over (partition by category order by item_id) - 1) / 50) + 1 as int) page from {lots}")
def _(s, d):
    rows = load(s, d, "lots").withColumn("k", F.row_number().over(Window.partitionBy("category").orderBy("item_id")) - 1)
    item = F.struct("item_id", "title", "price", F.lit("rub").alias("currency"), "ai_price", F.timestamp_seconds("published_at").alias("published_at"), F.lit(1).cast("long").alias("seller_id"), "category")
    pages = rows.groupBy("category", (F.floor(F.col("k") / 50) + 1).cast("int").alias("page")).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", item.alias("i")))), lambda x: x["i"]).alias("items"))
    return lots_of(pages.withColumn("captured_at", F.lit(None).cast("timestamp"))).select("category", "item_id", "price", "place", "page")


# ---- feeds

# the first query of a session bears the session's start, so the flagship isn't first
QUERIES["flagship_lot_events"] = QUERIES.pop("flagship_lot_events")

_MAPPED = "case operation_type " + " ".join(f"when '{k}' then '{v}'" for k, v in __import__("tidelog.schemas", fromlist=["x"]).PAYMENT_EVENTS.items()) + " end"


@query("pj1_payment_events", f"select operation_id, amount, {_MAPPED} event_type, counterparty_id, case when hold_end_date <> 0 then hold_end_date end hold_end from {{payments}} where {_MAPPED} is not null")
def _(s, d):
    rows = feeds.payment_events(load(s, d, "payments")).where("event_type is not null")
    return rows.select("operation_id", "amount", "event_type", "counterparty_id", F.unix_seconds(pl.unix_time(F.col("hold_end_date"))).alias("hold_end"))


@query("pj1_unmapped_counts", f"select operation_type, count(*) n_rows from {{payments}} where {_MAPPED} is null group by 1")
def _(s, d):
    return feeds.payment_events(load(s, d, "payments")).where("event_type is null").groupBy("operation_type").agg(F.count("*").alias("n_rows"))


_NKIND = "case content_type when 'market_dispute_opened' then 'dispute_opened' when 'market_claim_filed' then 'claim_filed' when 'market_lot_reserved' then 'lot_reserved' when 'market_purchase_confirmed' then 'purchase_confirmed' end"
_HAS = lambda k: f"json_exists(extra, '$.{k}')"
_GET = lambda k: f"try_cast(json_extract_string(extra, '$.{k}') as bigint)"


@query("pj2_notification_events", f"""select kind, notification_id, 'notif:' || kind || ':' || notification_id aggregate_id, coalesce(t, case kind when 'market' then 'market_notification_received' else 'forum_notification_received' end) event_type,
 case when t is null then null when {_HAS('item_id')} then {_GET('item_id')} when t in ('dispute_opened','claim_filed') then null else notification_id end item_id,
 case when t in ('dispute_opened','claim_filed') then case when {_HAS('claim_id')} then {_GET('claim_id')} else notification_id end end claim_id,
 case when t in ('lot_reserved','purchase_confirmed') and {_HAS('buyer_id')} then {_GET('buyer_id')} end buyer_id,
 case when t is not null and extra like '%"x7"%' then 'notification_extra_invalid:claim_id' end rejected from (select *, {_NKIND} t from {{notifications}})""")
def _(s, d):
    return feeds.notification_events(load(s, d, "notifications")).drop("content_type", "created_at", "extra")


@query("pj3_invoice_events", "select invoice_id, case status when 'paid' then 'invoice_paid' when 'expired' then 'invoice_expired' else 'invoice_created' end event_type, coalesce(nullif(event_id, ''), invoice_id || ':' || status) dedup_key from {invoices}")
def _(s, d):
    return feeds.invoice_events(load(s, d, "invoices")).select("invoice_id", "event_type", "dedup_key")


@query("io2_invoice_bodies", "select status <> 'refunded' good, invoice_id, case when status <> 'refunded' then status end status from {invoices}")
def _(s, d):
    body = F.when(F.col("status") == "refunded", F.concat(F.lit('{"invoice_id":'), "invoice_id")).otherwise(F.to_json(F.struct("invoice_id", "status", "event_id", F.lit("x").alias("other"))))
    good, rejected = parsed_invoices(load(s, d, "invoices").select(body.alias("body")))
    bad = rejected.select(F.lit(False).alias("good"), F.regexp_extract("body", "inv-[0-9]+", 0).alias("invoice_id"), F.lit(None).cast("string").alias("status"))
    return good.select(F.lit(True).alias("good"), "invoice_id", "status").unionByName(bad)


_PAYMENT_JSON = """'{"operation_id":' || operation_id || ',"amount":"' || amount || '","currency":"' || currency || '","counterparty_id":' || coalesce(cast(counterparty_id as varchar), 'null') || ',"counterparty_username":"' || counterparty_username || '","fee":' || fee || ',"is_hold":' || is_hold
 || ',"hold_end_date":' || coalesce('"' || strftime(make_timestamp(nullif(hold_end_date, 0) * 1000000), '%Y-%m-%dT%H:%M:%S+00:00') || '"', 'null') || ',"item_id":' || item_id || ',"comment":"' || comment || '"}'"""


@query("pj1_payment_payload", f"select operation_id, amount, {_PAYMENT_JSON} payload from {{payments}}")
def _(s, d):
    return load(s, d, "payments").select("operation_id", "amount", feeds.payment_payload().alias("payload"))


@query("pj4_payload_tags", "select user_id, poll, case when user_id % 20 <> 7 then '{\"account_alias\":\"acct-' || user_id % 20 || '\"}' else '{}' end payload from {profiles}")
def _(s, d):
    rows = load(s, d, "profiles").withColumn("account_id", F.col("user_id") % 20)
    return feeds.with_alias(rows, load(s, d, "accounts")).select("user_id", "poll", pl.tags(account_alias=F.col("account_alias")).alias("payload"))


@query("jn12_account_alias", "select operation_id, amount, account_id, case when account_id <> 7 then 'acct-' || account_id end account_alias from {payments}")
def _(s, d):
    return feeds.with_alias(load(s, d, "payments"), load(s, d, "accounts")).select("operation_id", "amount", "account_id", "account_alias")


@query("jn5_unseen", "select operation_id, amount from {payments} p where not exists (select 1 from {payments} q where q.operation_id = p.operation_id and q.amount = p.amount and q.operation_id % 7 < 3 and q.amount * 100 % 3 <> 0)")
def _(s, d):
    rows = load(s, d, "payments")
    return feeds.unseen(rows, rows.where("operation_id % 7 < 3 and amount * 100 % 3 <> 0"), "operation_id", "amount").select("operation_id", "amount")


@query("jn5_marks_of_a_day", """select operation_id, amount from {payments} p where not exists (select 1 from {payments} q where q.operation_id = p.operation_id and q.amount = p.amount and q.operation_id % 7 < 3
 and q.happened > (select max(happened) from {payments}) - 86400 * 400 + 86400 * 399 * cast(q.operation_id % 2 as bigint))""")
def _(s, d):
    """Marks older than a day count no more: even operations were marked 399 days after they happened."""
    rows = load(s, d, "payments")
    last = rows.agg(F.max("happened")).collect()[0][0]
    marked = F.timestamp_seconds(F.col("happened") + F.when(F.col("operation_id") % 2 == 0, 86400 * 399).otherwise(0))
    seen = rows.where("operation_id % 7 < 3").withColumn("marked_at", marked)
    return feeds.unseen(rows, seen, "operation_id", "amount", F.timestamp_seconds(F.lit(last))).select("operation_id", "amount")


@query("jn8_above_mark", "select p.account_id, operation_id, amount from {payments} p left join {payment_marks} m using (account_id) where operation_id > coalesce(mark, 0)")
def _(s, d):
    return feeds.above_mark(load(s, d, "payments"), load(s, d, "payment_marks"), "account_id", "operation_id").select("account_id", "operation_id", "amount")


_ABOVE = """above as (select p.*, sha256(operation_id || ':' || operation_type || ':' || amount) content_hash
  from {payments} p left join {payment_marks} m using (account_id) where operation_id > coalesce(mark, 0)),
 fresh as (select distinct * from above where operation_id % 7 <> 0)"""


def payment_poll(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A poll after which every seventh operation has been seen before."""
    rows = load(s, d, "payments")
    hash_ = ids.payment_hash(F.col("operation_id"), F.col("operation_type"), F.col("amount").cast("string"))
    seen = rows.where("operation_id % 7 = 0").select("operation_id", hash_.alias("content_hash")).distinct()
    return feeds.payment_job(rows, load(s, d, "payment_marks"), seen, 1, F.timestamp_seconds(F.lit(DAY_ZERO)))


@query("job_payment_feed", f"""with {_ABOVE}, typed as (select *, {_MAPPED} event_type from fresh where {_MAPPED} is not null),
 keyed as (select *, {SHA1.format(key="operation_id || '|' || event_type || '|' || content_hash || '|1'")} d from typed)
 select cast(row_number() over (order by operation_id, content_hash) + (select max(seq) from {{event_log}}) as bigint) seq, {UUID} event_id, event_type,
  cast(operation_id as varchar) aggregate_id, content_hash, {_PAYMENT_JSON} payload, cast(1 as bigint) poll_epoch from keyed""")
def _(s, d):
    events, _seen, _marks = payment_poll(s, d)
    before = load(s, d, "event_log").select("seq", F.col("raw_id").cast("string").alias("event_id"), "poll_epoch")
    added = log.append(events, before, ["operation_id", "content_hash"])
    return added.select("seq", "event_id", "event_type", "aggregate_id", "content_hash", "payload", "poll_epoch")


@query("job_payment_seen", f"with {_ABOVE} select distinct operation_id, content_hash from fresh")
def _(s, d):
    return payment_poll(s, d)[1]


@query("job_payment_marks", f"""with {_ABOVE} select account_id, max(mark) mark from (select account_id, mark from {{payment_marks}}
 union all select account_id, operation_id from above) group by 1""")
def _(s, d):
    return payment_poll(s, d)[2]


@query("jn8_new_marks", "select account_id, max(operation_id) mark from {payments} group by 1")
def _(s, d):
    return feeds.new_marks(load(s, d, "payments"), "account_id", "operation_id")


@query("jn9_conversation_events", """with due as (select c.conversation_id from {chats} c left join {chats_known} k using (conversation_id) left join {chats_updated} u on u.conversation_id = c.conversation_id and u.conversation_update_date = c.conversation_update_date where k.conversation_id is null or u.conversation_id is null or c.is_unread)
 select conversation_id, 'new_conversation' event_type, cast(null as bigint) message_id from {chats} where conversation_id not in (select conversation_id from {chats_known})
 union all select conversation_id, 'new_message', message_id from {messages} join {chat_marks} using (conversation_id) where message_id > mark and conversation_id in (select conversation_id from due)""")
def _(s, d):
    return feeds.conversation_events(*[load(s, d, n) for n in ("chats", "messages", "chats_known", "chats_updated", "chat_marks")])


@query("jn10_watch_list", "select item_id, ends guarantee_end from {watched}")
def _(s, d):
    rows = load(s, d, "purchases")
    text = F.when(F.col("vague"), "14 days").otherwise(pl.iso(F.timestamp_seconds("ends")))
    lots = rows.where("not no_lot").select("item_id", text.alias("guarantee"))
    return feeds.watch_list(rows.select("item_id"), lots).select("item_id", F.unix_seconds("guarantee_end").alias("guarantee_end"))


@query("sc6_guarantee_time", "select item_id, case when not vague then ends end as secs from {purchases}")
def _(s, d):
    text = F.when(F.col("vague"), "14 days").otherwise(pl.iso(F.timestamp_seconds("ends")))
    return load(s, d, "purchases").select("item_id", F.unix_seconds(pl.guarantee_time(text)).alias("secs"))


_TICKS = "select lo + 18000 * i t from (select min(happened) lo, max(ends) hi from {purchases}) cross join (select unnest(range(0, 40000)) i) where lo + 18000 * i <= hi + 18000"


def ticks(s: SparkSession, d: str) -> DataFrame:
    ends = load(s, d, "purchases").agg(F.min("happened").alias("lo"), F.max("ends").alias("hi"))
    return ends.select(F.explode(F.sequence("lo", F.col("hi") + 18000, F.lit(18000).cast("long"))).alias("t")).select(F.timestamp_seconds("t").alias("tick"))


@query("jn11_threshold_crossings", f"""with ticks as ({_TICKS}), first as (select item_id, ends, label, span, lo + 18000 * greatest(0, cast(ceil((greatest(ends - span, happened) - lo) / 18000) as bigint)) t from {{watched}} cross join (values ('24h', 86400), ('6h', 21600), ('1h', 3600)) w(label, span) cross join (select min(t) lo from ticks)),
 hit as (select * from first where t < ends) select item_id, ends guarantee_end, t tick, arg_min(label, span) label from hit group by 1, 2, 3""")
def _(s, d):
    watched = load(s, d, "watched").select("item_id", F.timestamp_seconds("ends").alias("guarantee_end"), F.timestamp_seconds("happened").alias("watched_from"))
    out = feeds.threshold_crossings(watched, ticks(s, d))
    return out.select("item_id", F.unix_seconds("guarantee_end").alias("guarantee_end"), F.unix_seconds("tick").alias("tick"), "label")


_LEVEL = "case when l <= 0 then 0 when l <= 3600 then 3 when l <= 21600 then 2 when l <= 86400 then 1 else 0 end"


@query("wn5_guarantee_levels", f"""with rows_ as (select item_id, k, {_LEVEL} level from (select item_id, k, ends + (item_id % 5) * 7200 * (k % 2) - (ends - 90000 + k * 5000) l from {{watched}} cross join (select unnest(range(0, 20)) k)))
 select item_id, k, level from (select *, coalesce(max(level) over (partition by item_id order by k rows between unbounded preceding and 1 preceding), 0) most from rows_) where level > most""")
def _(s, d):
    rows = load(s, d, "watched").withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(19)).cast("array<bigint>")))
    rows = rows.select("item_id", "k", F.timestamp_seconds(F.expr("ends + (item_id % 5) * 7200 * (k % 2)")).alias("guarantee_end"), F.timestamp_seconds(F.expr("ends - 90000 + k * 5000")).alias("tick"))
    return feeds.guarantee_levels(rows).select("item_id", "k", "level")


@query("wn4_rating_deltas", """select user_id, poll, delta_likes, delta_dislikes from (select *, user_like_count - lag(user_like_count) over w delta_likes, user_dislike_count - lag(user_dislike_count) over w delta_dislikes from {profiles} window w as (partition by user_id order by poll)) where delta_likes <> 0 or delta_dislikes <> 0""")
def _(s, d):
    return feeds.rating_changes(load(s, d, "profiles")).select("user_id", "poll", "delta_likes", "delta_dislikes")


@query("ag7_feed_changed", "select kind, max(notification_id) newest, kind <> 'market' changed from {notifications} group by 1")
def _(s, d):
    rows = load(s, d, "notifications")
    marks = rows.where("kind = 'market'").groupBy("kind").agg(F.max("notification_id").alias("mark"))
    return feeds.feed_changed(rows, marks, "kind", "notification_id")


@query("ag7_marks_above", """select kind, max(notification_id) newest, kind = 'nomarket' changed from {notifications} group by 1""")
def _(s, d):
    """A mark above the newest id: nothing is new. The other feed's mark is below."""
    rows = load(s, d, "notifications")
    marks = rows.groupBy("kind").agg((F.max("notification_id") + F.when(F.col("kind") == "market", 4).otherwise(-1)).alias("mark"))
    return feeds.feed_changed(rows, marks, "kind", "notification_id")


@query("sc1_event_ids", f"select {UUID} event_id, aggregate_id from (select *, {SHA1.format(key=chr(39) + 'x' + chr(39) + ' || aggregate_id || ' + chr(39) + '|' + chr(39) + ' || event_type || ' + chr(39) + '|' + chr(39) + ' || content_hash || ' + chr(39) + '|' + chr(39) + ' || poll_epoch')} d from {{event_log}})")
def _(s, d):
    rows = load(s, d, "event_log")
    return rows.select(ids.event_id(F.concat(F.lit("x"), "aggregate_id"), F.col("event_type"), F.col("content_hash"), F.col("poll_epoch")).alias("event_id"), "aggregate_id")


@query("sc2_content_hash", "select operation_id, sha256(operation_id || ':' || operation_type || ':' || amount) content_hash from {payments}")
def _(s, d):
    return load(s, d, "payments").select("operation_id", ids.payment_hash(F.col("operation_id"), F.col("operation_type"), F.col("amount").cast("string")).alias("content_hash"))


@query("sc3_payload", """select operation_id, '{"operation_id":' || operation_id || ',"amount":"' || amount || '","counterparty_id":' || coalesce(cast(counterparty_id as varchar), 'null') || ',"is_hold":' || is_hold || '}' payload from {payments}""")
def _(s, d):
    c = F.col
    return load(s, d, "payments").select("operation_id", pl.payload(operation_id=c("operation_id"), amount=c("amount").cast("string"), counterparty_id=c("counterparty_id"), is_hold=c("is_hold")).alias("payload"))


# ---- log

def stored(s: SparkSession, d: str) -> DataFrame:
    rows = load(s, d, "event_log").withColumn("occurred_at", F.timestamp_seconds("happened"))
    return rows.withColumn("event_id", ids.event_id(F.col("aggregate_id"), F.col("event_type"), F.col("content_hash"), F.col("poll_epoch")))


@query("wn7_numbering", "select seq, event_id raw_id from {numbered}")
def _(s, d):
    return log.positions(load(s, d, "events"), ["ts", "event_id"], "seq").select("seq", F.col("event_id").alias("raw_id"))


@query("io3_append", "select seq, raw_id, cast(row_number() over (order by raw_id) + (select max(seq) from {event_log} where seq % 3 <> 0) as bigint) new_seq from {event_log} where seq % 3 = 0")
def _(s, d):
    rows = stored(s, d).withColumnRenamed("seq", "old")
    have = rows.where("old % 3 != 0").withColumn("seq", F.col("old"))
    added = log.append(rows.unionByName(rows.where("old % 10 = 0")), have, ["raw_id"])
    return added.select(F.col("old").alias("seq"), "raw_id", F.col("seq").cast("long").alias("new_seq"))


@query("io4_decode", "select seq, category from {event_log} where event_type = 'new_lot'")
def _(s, d):
    return log.decoded(stored(s, d).drop("category"), "new_lot", "category string, missing long").select("seq", "category")


@query("st2_one_log", "select event_type, count(*) n_events from (select event_type from {event_log} union all select case status when 'paid' then 'invoice_paid' when 'expired' then 'invoice_expired' else 'invoice_created' end from {invoices}) group by 1")
def _(s, d):
    bills = feeds.invoice_events(load(s, d, "invoices")).select(ids.event_id(F.col("invoice_id"), F.col("event_type"), F.col("dedup_key"), F.lit(0)).alias("event_id"), "event_type", F.lit(1).alias("schema_version"), F.col("invoice_id").alias("aggregate_id"), F.lit(None).cast("timestamp").alias("occurred_at"), F.col("dedup_key").alias("content_hash"), F.lit("{}").alias("payload"), F.lit(0).cast("long").alias("poll_epoch"))
    return collect_sources(lambda: stored(s, d), lambda: bills).groupBy("event_type").agg(F.count("*").alias("n_events"))


@query("tk1_read_after", "select seq, event_type from {event_log} where seq > 300 order by seq limit 100")
def _(s, d):
    return log.read_after(load(s, d, "event_log"), 300, 100).select("seq", "event_type")


@query("wn6_pages", "select cast(floor((seq - 101) / 500) as bigint) page, count(*) n_events, min(seq) first_seq, max(seq) next_seq from {event_log} where seq > 100 group by 1")
def _(s, d):
    return log.pages(load(s, d, "event_log"), 100, 500)


@query("wn6_pages_pruned", "select cast(floor((pos - 1) / 200) as bigint) page, count(*) n_events, min(seq) first_seq, max(seq) next_seq from (select seq, row_number() over (order by seq) pos from {event_log} where seq > 100 and seq % 7 <> 0) group by 1")
def _(s, d):
    return log.pages(load(s, d, "event_log").where("seq % 7 != 0"), 100, 200, pruned=True)


@query("ag2_head", "select coalesce(max(seq), 0) head from {event_log}")
def _(s, d):
    return log.head(load(s, d, "event_log"))


_NOW = "(select max(happened) from {event_log})"


@query("job_op1_prune", f"select seq from {{event_log}} where not (seq <= (select min(last_seq) from {{cursors}}) and happened < {_NOW} - 86400 * 10)")
def _(s, d):
    rows = stored(s, d)
    now = rows.agg(F.max("occurred_at")).collect()[0][0]
    return log.prune(rows, load(s, d, "cursors"), F.lit(now) + F.expr("interval 20 days"), 1)[0].select("seq")


# ---- consumers

def subs(s: SparkSession, d: str) -> DataFrame:
    rows = load(s, d, "subscriptions").withColumn("event_types", F.split("type_list", ","))
    return rows.withColumn("filters", consume.scope_filters(F.col("scope_kind"), F.col("category"), F.col("account_alias"))).drop("category")


def slim(s: SparkSession, d: str) -> DataFrame:
    return load(s, d, "event_log").select("seq", "event_type", "payload", "aggregate_id")


@query("jn6_fan_out", "select consumer_name, seq from {matched}")
def _(s, d):
    return consume.fan_out(slim(s, d), subs(s, d)).select("consumer_name", "seq")


@query("jn6_fan_out_hot", "select consumer_name, seq from {matched}")
def _(s, d):
    """The same with keys above a few hundred events dealt out."""
    rows = slim(s, d)
    return consume.fan_out(rows, subs(s, d), consume.hot_keys(rows, 300)).select("consumer_name", "seq")


@query("fl1_match", "select seq, event_type in ('new_lot', 'price_dropped') and coalesce(category = 'small', false) matches from {event_log}")
def _(s, d):
    asked = F.create_map(F.lit("category"), F.lit("small"))
    return slim(s, d).select("seq", consume.matches(F.col("event_type"), F.col("payload"), F.array(F.lit("new_lot"), F.lit("price_dropped")), asked).alias("matches"))


@query("fl2_scope_filters", "select consumer_name, case scope_kind when 'category' then '{\"category\":\"' || category || '\"}' when 'account' then '{\"account_alias\":\"' || account_alias || '\"}' else '{}' end filters, scope_kind back from {subscriptions}")
def _(s, d):
    return subs(s, d).select("consumer_name", F.to_json("filters").alias("filters"), consume.filters_scope(F.col("filters")).alias("back"))


@query("fl3_validation", """select consumer_name, case when scope_kind = 'none' then '' else list_aggregate(list_sort(list_filter(string_split(type_list, ','), lambda x: case when scope_kind = 'category' then x not in ('new_lot','price_dropped','lot_updated','lot_disappeared','snapshot_initialized') else x <> 'rating_changed' end)), 'string_agg', ',') end unsupported,
 case when type_list like '%no_such_event%' then 'no_such_event' else '' end unknown_types, scope_kind = 'account' and account_alias not in (select alias from {accounts}) alias_missing from {subscriptions}""".replace("list_aggregate(", "coalesce(list_aggregate(").replace("'string_agg', ',') end unsupported", "'string_agg', ','), '') end unsupported"))
def _(s, d):
    out = consume.validated(subs(s, d), load(s, d, "accounts"))
    return out.select("consumer_name", F.array_join(F.sort_array("unsupported"), ",").alias("unsupported"), F.array_join("unknown_types", ",").alias("unknown_types"), "alias_missing")


@query("fl4_narrowed", "select consumer_name, count(*) n_events from {event_log} l join {subscriptions} s on l.event_type = 'lot_updated' and s.active and (s.scope_kind = 'none' or (s.scope_kind = 'category' and l.category = s.category)) group by 1")
def _(s, d):
    asked = subs(s, d).withColumn("event_types", consume.narrowed(F.col("event_types"), ["lot_updated"]))
    return consume.fan_out(slim(s, d), asked).groupBy("consumer_name").agg(F.count("*").alias("n_events"))


@query("fl6_price_drops", f"with {_LATEST} select category, item_id, n from history where event_type = 'price_dropped' and price < old_price * 0.85")
def _(s, d):
    return history(s, d).where("event_type = 'price_dropped' and price < old_price * 0.85").select("category", "item_id", "n")


@query("jn7_catch_up", "select consumer_name, seq from {matched} left join {cursors} using (consumer_name) where seq > coalesce(last_seq, 0)")
def _(s, d):
    return consume.catch_up(slim(s, d), subs(s, d), load(s, d, "cursors")).select("consumer_name", "seq")


@query("tk2_peek", """with thin as (select seq, row_number() over (order by seq) pos from {event_log} where seq % 7 <> 0), a as (select consumer_name, coalesce(last_seq, 0) last_read_seq from {subscriptions} left join {cursors} using (consumer_name) where active),
 st as (select *, (select count(*) from thin where seq <= last_read_seq) st from a), sc as (select consumer_name, last_read_seq, count(seq) scanned, max(seq) next_seq from st left join thin on pos > st and pos <= st + 100 group by 1, 2)
 select consumer_name, last_read_seq, (select count(*) from {matched} m join thin t using (seq) join st using (consumer_name) where m.consumer_name = sc.consumer_name and t.pos > st.st and t.pos <= st.st + 100) n_items, coalesce(next_seq, last_read_seq) next_seq, scanned < 100 drained from sc""")
def _(s, d):
    return consume.peek(slim(s, d).where("seq % 7 != 0"), subs(s, d), load(s, d, "cursors"), 100)


@query("ag3_watermark", "select min(last_seq) watermark from {cursors}")
def _(s, d):
    return consume.watermark(load(s, d, "cursors"))


@query("ag4_latest_cursors", "select consumer_name, arg_max(last_seq, version) last_seq, max(version) version from {cursor_log} group by 1")
def _(s, d):
    return consume.latest_cursors(load(s, d, "cursor_log"))


@query("ag5_lag", "select consumer_name, (select max(seq) from {event_log}) - last_seq lag, (select max(seq) from {event_log}) - last_seq > 500 alarm from {cursors}")
def _(s, d):
    return consume.lag(load(s, d, "cursors"), load(s, d, "event_log"), 500)


@query("job_op2_replay", "select consumer_name, case when consumer_name = 'sink:5' then 17 else last_seq end last_seq from {cursors}")
def _(s, d):
    return consume.replayed(load(s, d, "cursors"), "sink:5", 17)


@query("job_op4_start_position", "select consumer_name, case when transport in ('webhook', 'polling') then case when backfill then 0 else (select count(*) from {events}) end else greatest(coalesce(try_cast(case c_custkey % 3 when 0 then 'abc' when 1 then '-4' else cast(c_custkey as varchar) end as bigint), 0), 0) end start from {subscriptions}")
def _(s, d):
    given = F.expr("case c_custkey % 3 when 0 then 'abc' when 1 then '-4' else cast(c_custkey as string) end")
    rows = load(s, d, "subscriptions").crossJoin(log.head(load(s, d, "event_log")))
    return rows.select("consumer_name", consume.start_position(F.col("transport"), F.col("backfill"), given, F.col("head")).alias("start"))


@query("job_op5_confirm_read", "select consumer_name, greatest(last_seq, (c_custkey * 11) % 900) last_seq from {cursors} join {subscriptions} using (consumer_name)")
def _(s, d):
    requests = load(s, d, "subscriptions").select("consumer_name", ((F.col("c_custkey") * 11) % 900).alias("up_to_seq"))
    return consume.confirmed_reads(load(s, d, "cursors"), requests)


@query("job_op6_drop_inactive", "select consumer_name, last_seq from {cursors} where consumer_name not in (select consumer_name from {subscriptions} where not active)")
def _(s, d):
    return consume.without_inactive(load(s, d, "cursors"), load(s, d, "subscriptions"))


# ---- delivery

_BODY = """'{' || case when account_alias is not null then '"account_alias":"' || account_alias || '",' else '' end || '"aggregate_id":"' || aggregate_id || case when category is not null then '","category":"' || category else '' end || '","event_id":"' || raw_id || '","event_type":"' || event_type || '","occurred_at":"' || strftime(make_timestamp(happened * 1000000), '%Y-%m-%dT%H:%M:%S+00:00') || '","schema_version":1,"seq":' || seq || '}'"""


def bodies(s: SparkSession, d: str) -> DataFrame:
    return delivery.with_body(stored(s, d).withColumn("event_id", F.col("raw_id").cast("string")))


@query("sc4_canonical", f"select seq, {_BODY} body from {{event_log}}")
def _(s, d):
    return bodies(s, d).select("seq", "body")


_PAD = lambda n: f"unhex(array_to_string(list_transform(range(0, 64), lambda i: printf('%02x', xor(case when i < length(secret) then ascii(substr(secret, cast(i as int) + 1, 1)) else 0 end, {n}))), ''))"


@query("sc5_io5_outbox", f"""with keys as (select consumer_name, c_custkey, {_PAD(54)} ipad, {_PAD(92)} opad from (select *, 's-' || consumer_name secret from {{subscriptions}})),
 sent as (select k.consumer_name, l.seq, 'https://example.org/' || k.c_custkey endpoint, {_BODY} body, ipad, opad, cast(raw_id as varchar) event_id from (select consumer_name, seq m_seq from {{matched}}) m join keys k using (consumer_name) join {{event_log}} l on l.seq = m_seq)
 select consumer_name, seq, endpoint, body, 'sha256=' || sha256(opad || unhex(sha256(ipad || encode(body)))) signature, event_id idempotency_key, 'application/json' content_type from sent""")
def _(s, d):
    # one file of subscriptions is one task: deal them before their keys are made
    who = pl.with_pads(subs(s, d).repartition("consumer_name").withColumn("secret", F.concat(F.lit("s-"), "consumer_name")).withColumn("endpoint", F.concat(F.lit("https://example.org/"), "c_custkey")), "secret")
    out = delivery.outbox(consume.fan_out(bodies(s, d).drop("category", "account_alias"), who.drop("account_alias")))
    header = lambda k: F.element_at("headers", k)
    return out.select("consumer_name", "seq", "endpoint", "body", header("X-Signature").alias("signature"), header("Idempotency-Key").alias("idempotency_key"), header("Content-Type").alias("content_type"))


@query("io6_sse_frames", "select seq, 'id: ' || seq || chr(10) || 'event: ' || event_type || chr(10) || 'data: ' || payload || chr(10) || chr(10) frame from {event_log}")
def _(s, d):
    return delivery.sse_frames(slim(s, d).withColumn("data", F.col("payload")))


@query("io6_envelope_frames", f"""select seq, 'id: ' || seq || chr(10) || 'event: ' || event_type || chr(10) || 'data: ' || {_BODY} || chr(10) || chr(10) frame from {{event_log}}""")
def _(s, d):
    """What a stream's client gets: the whole envelope."""
    return delivery.sse_frames(bodies(s, d).withColumn("data", F.col("body")))


@query("tk2_pending_items", f"""with thin as (select *, row_number() over (order by seq) pos from {{event_log}} where seq % 7 <> 0), a as (select consumer_name, coalesce(last_seq, 0) last_read_seq from {{subscriptions}} left join {{cursors}} using (consumer_name) where active),
 st as (select *, (select count(*) from thin where seq <= last_read_seq) st from a)
 select consumer_name, seq, event_type, {_BODY} body from {{matched}} m join st using (consumer_name) join (select seq seq_, pos, raw_id, account_alias, category from thin) t on t.seq_ = m.seq where pos > st and pos <= st + 100""")
def _(s, d):
    """The items of every subscription's next 100 rows, as its client gets them."""
    at = subs(s, d).where("active").join(load(s, d, "cursors"), "consumer_name", "left").withColumn("last_seq", F.coalesce("last_seq", F.lit(0)))
    rows = bodies(s, d).where("seq % 7 != 0").select("seq", "event_type", "payload", "body")
    return consume.pending(rows, at, 100).where("hit").select("consumer_name", "seq", "event_type", "body")


_CLASS = """cl as (select *, case when error like 'unsafe_url:%' then 'terminal' when error is not null then 'retry' when status between 200 and 299 and coalesce(ok, true) then 'delivered' when status between 200 and 299 or status >= 500 or status in (408, 429) then 'retry' else 'terminal' end result,
 case when error is not null then error when status between 200 and 299 and not coalesce(ok, true) then 'receiver_requested_retry' when not status between 200 and 299 then 'http_' || status end reason from {attempts} where attempt <= 4)"""
_OUT = _CLASS + """, ends as (select consumer_name, seq, min(attempt) filter (result <> 'retry') e from cl group by 1, 2), live as (select cl.* from cl join ends using (consumer_name, seq) where e is null or attempt <= e),
 done as (select consumer_name, seq, arg_max(result, attempt) last_, arg_max(coalesce(reason, ''), attempt) r, count(*) n_attempts from live group by 1, 2),
 outc as (select consumer_name, seq, case when last_ = 'delivered' then 'delivered' when last_ = 'terminal' or n_attempts >= 4 then 'dead' else 'pending' end outcome, r, n_attempts from done)"""


@query("ag9_outcomes", f"with {_OUT} select consumer_name, seq, outcome, case when outcome = 'dead' then r end reason, n_attempts from outc")
def _(s, d):
    return delivery.outcomes(load(s, d, "attempts"), 4)


@query("ag6_dead_counts", f"with {_OUT} select consumer_name, count(*) n_dead from outc where outcome = 'dead' group by 1")
def _(s, d):
    return delivery.dead_counts(delivery.dead_letters(delivery.outcomes(load(s, d, "attempts"), 4), stored(s, d)))


@query("ag6_dead_list", f"with {_OUT} select consumer_name, seq, r reason, cast(row_number() over (partition by consumer_name order by seq) as int) place from outc where outcome = 'dead'")
def _(s, d):
    return delivery.dead_list(dead(s, d)).select("consumer_name", "seq", "reason", "place")


def dead(s: SparkSession, d: str) -> DataFrame:
    return delivery.dead_letters(delivery.outcomes(load(s, d, "attempts"), 4), stored(s, d))


@query("sc8_dead_letters", f"with {_OUT} select consumer_name, seq, r reason, event_type, aggregate_id, happened, content_hash, schema_version, payload from outc join {{event_log}} using (seq) where outcome = 'dead'")
def _(s, d):
    c = F.col
    packed = dead(s, d).select("consumer_name", "seq", "reason", pl.pack_dead_letter(c("event_type"), c("aggregate_id"), c("occurred_at"), c("content_hash"), c("schema_version"), c("payload")).alias("packed"))
    out = packed.select("consumer_name", "seq", "reason", *pl.unpack_dead_letter(F.col("packed")))
    return out.withColumn("happened", F.unix_seconds("occurred_at")).drop("occurred_at")


@query("job_op3_redrive", f"""with {_OUT}, dead as (select consumer_name, seq from outc where outcome = 'dead')
 select c.consumer_name, case when c_custkey % 2 = 0 and m is not null then greatest(m - 1, 0) else last_seq end last_seq from {{cursors}} c join {{subscriptions}} using (consumer_name) left join (select consumer_name, min(seq) m from dead group by 1) using (consumer_name)
 union all select s.consumer_name, greatest(min(seq) - 1, 0) from dead join {{subscriptions}} s using (consumer_name) where c_custkey % 2 = 0 and s.consumer_name not in (select consumer_name from {{cursors}}) group by 1""")
def _(s, d):
    who = load(s, d, "subscriptions").where("c_custkey % 2 = 0").select("consumer_name")
    return consume.redriven(dead(s, d).select("consumer_name", "seq"), load(s, d, "cursors"), who)[1]


@query("wn8_retry_schedule", f"""with {_CLASS}, rt as (select *, coalesce(sum(case when reason = 'receiver_requested_retry' then 0 else 1 end) over (partition by consumer_name, seq order by attempt rows between unbounded preceding and 1 preceding), 0) k from cl where result = 'retry'),
 w as (select *, cast(case when attempt >= 4 then 0 when reason = 'receiver_requested_retry' then least(case when retry_after > 0 then retry_after else 2 end, 20) else least(2 * pow(2, k), 10) end as double) wait from rt)
 select consumer_name, seq, attempt, wait, sum(wait) over (partition by consumer_name, seq order by attempt) waited from w""")
def _(s, d):
    rows = delivery.retry_schedule(load(s, d, "attempts").where("attempt <= 4"), 2.0, 10.0, 20.0, 4)
    return rows.select("consumer_name", "seq", "attempt", "wait", "waited")


@query("wn8_bus_wait", "select distinct attempt, cast(least(0.5 * pow(2, attempt), 8) as double) wait from {attempts}")
def _(s, d):
    return load(s, d, "attempts").select("attempt").distinct().select("attempt", delivery.bus_wait(F.col("attempt"), 0.5, 8.0).alias("wait"))


@query("ex1_router", "select 'drops' handler, count(*) n_events from {event_log} where event_type in ('price_dropped', 'new_lot') and category = 'small' union all select 'ratings', count(*) from {event_log} where event_type = 'rating_changed'")
def _(s, d):
    router = Router()
    router.on("price_dropped", "new_lot", filters={"category": "small"})(lambda e: e.agg(F.count("*").alias("n_events")).select(F.lit("drops").alias("handler"), "n_events"))
    router.on("rating_changed")(lambda e: e.agg(F.count("*").alias("n_events")).select(F.lit("ratings").alias("handler"), "n_events"))
    first, second = router.handle(slim(s, d))
    return first.unionByName(second)


@query("ex2_extended_payments", f"select operation_id, amount, coalesce({_MAPPED}, case operation_type when 'cashback' then 'income_received' end) event_type from {{payments}} where operation_type <> 'bonus'")
def _(s, d):
    from tidelog.schemas import PAYMENT_EVENTS

    rows = feeds.payment_events(load(s, d, "payments"), PAYMENT_EVENTS | {"cashback": "income_received"})
    return rows.where("event_type is not null").select("operation_id", "amount", "event_type")


@query("ex3_custom_source", "select aggregate_id, count(*) n_events from (select cast(conv_id as varchar) aggregate_id from {conversations}) group by 1")
def _(s, d):
    def source() -> DataFrame:
        m = load(s, d, "messages")
        return m.select(ids.event_id(F.col("message_id").cast("string"), F.lit("new_message"), ids.keyed_hash("message", F.col("message_id")), F.lit(1)).alias("event_id"), F.lit("new_message").alias("event_type"), F.lit(1).alias("schema_version"), F.col("conversation_id").cast("string").alias("aggregate_id"), F.lit(None).cast("timestamp").alias("occurred_at"), ids.keyed_hash("message", F.col("message_id")).alias("content_hash"), F.lit("{}").alias("payload"), F.lit(1).cast("long").alias("poll_epoch"))

    return collect_sources(source).groupBy("aggregate_id").agg(F.count("*").alias("n_events"))


# ---- streams: tables that Spark derives, read as files that arrive, by all that is there

def rating_rows(s: SparkSession, d: str) -> DataFrame:
    return load(s, d, "profiles").select("user_id", "poll", F.timestamp_seconds(F.col("poll") * 86400).alias("polled_at"), *[F.col(c).cast("int").alias(c) for c in ("user_like_count", "user_dislike_count")])


def arriving_twice(rows: DataFrame) -> list[DataFrame]:
    """Parts in order of time, each with the rows of the part before once more."""
    parts, _ = streams.out_of_order(rows, F.unix_seconds("occurred_at"), tuple(range(streams.SLICES)))
    return [parts[0].union(parts[0]), *[now.union(before) for before, now in zip(parts, parts[1:])]]


@query("ss2_deduplicated", "select seq, event_type from {event_log}")
def _(s, d):
    rows = stored(s, d).select("event_id", "seq", "event_type", "occurred_at")
    return streams.run(arriving_twice(rows), jobs.deduplicated, "ss2").select("seq", "event_type")


@query("ss2_after_a_day", "select seq, event_type from {event_log} union all select seq, event_type from {event_log} where seq % 10 = 0")
def _(s, d):
    """Marks leave state after a day: an id that comes again three weeks later is new."""
    rows = stored(s, d).select("event_id", "seq", "event_type", "occurred_at")
    again = rows.where("seq % 10 = 0").withColumn("occurred_at", F.col("occurred_at") + F.expr("interval 21 days"))
    return streams.run(arriving_twice(rows.union(again)), jobs.deduplicated, "ss2").select("seq", "event_type")


@query("ss3_rating_deltas", """select user_id, poll, cast(delta_likes as int) delta_likes, cast(delta_dislikes as int) delta_dislikes from (select *, user_like_count - lag(user_like_count) over w delta_likes, user_dislike_count - lag(user_dislike_count) over w delta_dislikes from {profiles} window w as (partition by user_id order by poll)) where delta_likes <> 0 or delta_dislikes <> 0""")
def _(s, d):
    parts, late = streams.out_of_order(rating_rows(s, d), F.unix_seconds("polled_at"))
    return streams.run([*parts, later(parts[0], "polled_at", late)], lambda rows: jobs.rating_deltas(rows, late), "ss3").select("user_id", "poll", "delta_likes", "delta_dislikes")


def later(rows: DataFrame, time: str, late: str) -> DataFrame:
    """One row of nobody, so late that the watermark passes all others when it has come."""
    names = [f.name for f in rows.schema.fields if f.name != time]
    end = F.make_timestamp(F.lit(2100), F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0)) + F.expr(f"interval '{late.split()[0]}' second")
    one = rows.sparkSession.range(1).select(*[F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in names], end.alias(time))
    return one.select(rows.columns)


@query("ss4_guarantee_levels", f"""with rows_ as (select item_id, tick, {_LEVEL} level from (select item_id, ends - 90000 + k * 5000 tick, ends - (ends - 90000 + k * 5000) l from {{watched}} cross join (select unnest(range(0, 20)) k)))
 select item_id, tick, case level when 1 then '24h' when 2 then '6h' else '1h' end as label from (select *, coalesce(max(level) over (partition by item_id order by tick rows between unbounded preceding and 1 preceding), 0) most from rows_) where level > most""")
def _(s, d):
    rows = load(s, d, "watched").withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(19)).cast("array<bigint>")))
    rows = rows.select("item_id", F.timestamp_seconds("ends").alias("guarantee_end"), F.timestamp_seconds(F.expr("ends - 90000 + k * 5000")).alias("tick"))
    parts, late = streams.out_of_order(rows, F.unix_seconds("tick"))
    found = streams.run([*parts, later(rows, "tick", late)], lambda r: jobs.guarantee_levels(r, late), "ss4")
    return found.select("item_id", F.unix_seconds("tick").alias("tick"), "label")


# a purchase puts an item on the list; some ends move 50,000 s before, some items go 10,000 s before the end
_TIMED = """walk as (select item_id, happened lo, case when item_id % 5 = 0 and ends - 50000 > happened then ends - 50000 when item_id % 7 = 0 and ends - 10000 > happened then ends - 10000 else ends end hi, ends,
   item_id % 5 = 0 and ends - 50000 > happened moved from {watched}),
 w as (select * from (values ('24h', 86400), ('6h', 21600), ('1h', 3600)) w(label, span)),
 first_ as (select item_id, label, span, greatest(lo, ends - span) fires, ends, moved, hi from walk cross join w where ends > lo),
 early as (select * from first_ where fires < hi),
 more as (select f.item_id, f.label, f.span, greatest(f.hi, f.ends + 100000 - f.span) fires, f.ends + 100000 ends from first_ f where f.moved and not f.fires < f.hi),
 fired as (select item_id, label, span, fires, ends from early union all select * from more)"""


@query("ss4_guarantee_timers", f"with {_TIMED} select item_id, fires as tick, arg_min(label, span) label, ends guarantee_end from fired group by item_id, fires, ends")
def _(s, d):
    rows = load(s, d, "watched").withColumn("moves", F.expr("item_id % 5 = 0 and ends - 50000 > happened")).withColumn("goes", F.expr("not moves and item_id % 7 = 0 and ends - 10000 > happened"))
    row = lambda kind, tick, ends: F.struct(F.lit(kind).alias("kind"), F.timestamp_seconds(F.expr(tick)).alias("tick"), F.timestamp_seconds(F.expr(ends)).alias("guarantee_end"))
    every = F.array(row("seed", "happened", "ends"), F.when(F.col("moves"), row("read", "ends - 50000", "ends + 100000")), F.when(F.col("goes"), row("gone", "ends - 10000", "cast(null as bigint)")))
    rows = rows.select("item_id", F.explode(F.filter(every, lambda x: x.isNotNull())).alias("r")).select("item_id", "r.kind", "r.tick", "r.guarantee_end")
    parts, late = streams.out_of_order(rows, F.unix_seconds("tick"))
    found = streams.run([*parts, later(rows, "tick", late)], lambda r: jobs.guarantee_timers(r, late), "ss4-timers")
    return found.select("item_id", F.unix_seconds("tick").alias("tick"), "label", F.unix_seconds("guarantee_end").alias("guarantee_end"))


def log_in_runs(s: SparkSession, d: str, runs: int) -> str:
    """The folder of a log with the events in order of their numbers, committed in several runs."""
    folder = f"{streams.shared_folder(s, 'log')}/log"
    rows = log.stable(stored(s, d).withColumnRenamed("seq", "old"))
    size = rows.count() // runs + 1
    for k in range(runs):
        part = rows.where((F.col("old") > k * size) & (F.col("old") <= (k + 1) * size))
        log.commit(part.select("old", *EVENT_COLUMNS), folder, k, ["old"])
    return folder


@query("ss5_catch_up_consumers", "select consumer_name, seq from {matched} left join {cursors} using (consumer_name) where seq > coalesce(last_seq, 0)")
def _(s, d):
    """All subscriptions from their cursors on, run after run; a number that a consumer gets out of order shows as 0."""
    log_folder = log_in_runs(s, d, 2)
    folder = streams.shared_folder(s, "ss5")
    consumers.advance(s, folder, 0, load(s, d, "cursors"))
    who = lambda: subs(s, d)
    stream = consumers.new_heads(s, log_folder).writeStream.foreachBatch(consumers.catch_up(log_folder, folder, who))
    stream.option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    rows = consumers.delivered(s, folder, consumers.DELIVERY)
    before = F.coalesce(F.max("seq").over(Window.partitionBy("consumer_name").orderBy("version", "seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("_before", before).select("consumer_name", F.when(F.col("seq") > F.col("_before"), F.col("seq")).otherwise(0).alias("seq"))


# ---- every feed as rows of the log

def conversations_of(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    c = F.col
    chats = load(s, d, "chats").select("conversation_id", "conversation_update_date", "is_unread", F.concat(F.lit("chat "), "conversation_id").alias("conversation_title"), (c("conversation_id") % 50).alias("creator_user_id"), F.concat(F.lit("user-"), c("conversation_id") % 50).alias("creator_username"), F.lit("inbox").alias("folder"))
    texts = load(s, d, "messages").select("conversation_id", "message_id", (c("turn") % 2).cast("long").alias("creator_user_id"), c("text").alias("message_body_plain_text"), c("is_system").alias("message_is_system"))
    return chats, texts


def feed_log(s: SparkSession, d: str) -> DataFrame:
    """The events of a poll of every feed, and of the whole history of lots, ratings and guarantees."""
    zero = F.timestamp_seconds(F.lit(DAY_ZERO))
    rows = load(s, d, "notifications")
    marks = rows.groupBy("kind").agg(F.lit(0).cast("long").alias("mark"))
    seen = rows.where("notification_id % 9 = 0").select("notification_id", F.concat_ws(":", "content_type", "created_at").alias("content_hash"))
    changes = feeds.with_alias(feeds.rating_changes(load(s, d, "profiles")).withColumn("account_id", F.col("user_id") % 20), load(s, d, "accounts"))
    watched = load(s, d, "watched").select("item_id", F.timestamp_seconds("ends").alias("guarantee_end"), F.timestamp_seconds("happened").alias("watched_from"))
    chats, texts = conversations_of(s, d)
    bills = load(s, d, "invoices").withColumns({"amount": F.lit("1.50"), "currency": F.lit(None).cast("string")})
    return log.one_log(
        lot_events(s, d), payment_poll(s, d)[0], feeds.notification_job(rows, marks, seen, 1)[0], feeds.invoice_job(bills, zero), feeds.rating_job(changes, zero),
        feeds.conversation_job(chats, texts, *[load(s, d, n) for n in ("chats_known", "chats_updated", "chat_marks")], 1, zero)[0],
        feeds.guarantee_job(feeds.threshold_crossings(watched, ticks(s, d)), F.lit(1)),
    )


_N = lambda x: f"coalesce(cast({x} as varchar), 'null')"
_ISO = lambda x: f"strftime(make_timestamp({x} * 1000000), '%Y-%m-%dT%H:%M:%S+00:00')"
_FEED_LOG = f"""{_ABOVE}, {_LATEST}, marks_ as (select f.category, f.poll_epoch, count(distinct o.item_id) lot_count from (select category, min(poll_epoch) poll_epoch from {{polls}} group by 1) f left join {{lot_observations}} o using (category, poll_epoch) group by all),
 gone as (select category, item_id, poll_epoch, row_number() over (partition by category, poll_epoch order by item_id) k from history where event_type = 'lot_disappeared'),
 why as (select category, item_id, poll_epoch, {_REASON} reason from gone left join {{lot_states}} using (item_id)),
 nots as (select *, {_NKIND} t, 'notif:' || kind || ':' || notification_id aggregate_id, content_type || ':' || created_at content_hash from {{notifications}} where notification_id % 9 <> 0),
 rates as (select * from (select *, user_like_count - lag(user_like_count) over w dl, user_dislike_count - lag(user_dislike_count) over w dd from {{profiles}} window w as (partition by user_id order by poll)) where dl <> 0 or dd <> 0),
 due as (select c.conversation_id from {{chats}} c left join {{chats_known}} k using (conversation_id) left join {{chats_updated}} u on u.conversation_id = c.conversation_id and u.conversation_update_date = c.conversation_update_date where k.conversation_id is null or u.conversation_id is null or c.is_unread),
 tick0 as ({_TICKS}), cross_ as (select item_id, ends, label, span, lo + 18000 * greatest(0, cast(ceil((greatest(ends - span, happened) - lo) / 18000) as bigint)) t from {{watched}} cross join (values ('24h', 86400), ('6h', 21600), ('1h', 3600)) w(label, span) cross join (select min(t) lo from tick0)),
 feed as (select cast(h.item_id as varchar) aggregate_id, h.event_type, h.content_hash, h.poll_epoch, '{{"category":"' || h.category || '"' || {_FIELD('price')} || {_FIELD('old_price')} || coalesce(',"reason":"' || reason || '","confidence":"' || case reason when 'unknown' then 'low' else 'normal' end || '"', '') || '}}' payload
    from history h left join why on h.event_type = 'lot_disappeared' and h.category = why.category and h.item_id = why.item_id and h.poll_epoch = why.poll_epoch
  union all select category, 'snapshot_initialized', 'bootstrap:' || lot_count, poll_epoch, '{{"category":"' || category || '","lot_count":' || lot_count || '}}' from marks_
  union all select cast(operation_id as varchar), {_MAPPED}, content_hash, 1, {_PAYMENT_JSON} from fresh where {_MAPPED} is not null
  union all select aggregate_id, t, content_hash, 1, '{{"claim_id":' || {_N("case when " + _HAS("claim_id") + " then " + _GET("claim_id") + " else notification_id end")} || ',"item_id":' || {_N("case when " + _HAS("item_id") + " then " + _GET("item_id") + " end")} || '}}' from nots where t in ('dispute_opened', 'claim_filed') and extra not like '%"x7"%'
  union all select aggregate_id, t, content_hash, 1, '{{"item_id":' || {_N("case when " + _HAS("item_id") + " then " + _GET("item_id") + " else notification_id end")} || ',"buyer_id":' || {_N("case when " + _HAS("buyer_id") + " then " + _GET("buyer_id") + " end")} || '}}' from nots where t in ('lot_reserved', 'purchase_confirmed') and extra not like '%"x7"%'
  union all select aggregate_id, case kind when 'market' then 'market_notification_received' else 'forum_notification_received' end, content_hash, 1, '{{"notification_id":' || notification_id || ',"content_type":"' || content_type || '","created_at":"' || {_ISO("created_at")} || '"}}' from nots where t is null
  union all select invoice_id, case status when 'paid' then 'invoice_paid' when 'expired' then 'invoice_expired' else 'invoice_created' end, coalesce(nullif(event_id, ''), invoice_id || ':' || status), 0, '{{"invoice_id":"' || invoice_id || '","status":"' || status || '","amount":"1.50","currency":null}}' from {{invoices}}
  union all select cast(user_id as varchar), 'rating_changed', 'rating:' || user_id || ':' || user_like_count || ':' || user_dislike_count, poll, '{{' || case when user_id % 20 <> 7 then '"account_alias":"acct-' || user_id % 20 || '",' else '' end || '"user_like_count":' || user_like_count || ',"user_dislike_count":' || user_dislike_count || ',"delta_likes":' || dl || ',"delta_dislikes":' || dd || '}}' from rates
  union all select cast(conversation_id as varchar), 'new_conversation', 'conversation:' || conversation_id, 1, '{{"conversation_id":' || conversation_id || ',"conversation_title":"chat ' || conversation_id || '","creator_user_id":' || conversation_id % 50 || ',"creator_username":"user-' || conversation_id % 50 || '","folder":"inbox"}}' from {{chats}} where conversation_id not in (select conversation_id from {{chats_known}})
  union all select cast(message_id as varchar), 'new_message', 'message:' || message_id, 1, '{{"message_id":' || message_id || ',"conversation_id":' || conversation_id || ',"author_user_id":' || turn % 2 || ',"message_text":' || coalesce(cast(to_json(text) as varchar), 'null') || ',"is_system":' || is_system || ',"folder":"inbox"}}' from {{messages}} join {{chat_marks}} using (conversation_id) where message_id > mark and conversation_id in (select conversation_id from due)
  union all select cast(item_id as varchar), 'guarantee_expiring', 'guarantee:' || item_id || ':' || arg_min(label, span), 1, '{{"item_id":' || item_id || ',"guarantee_end":"' || {_ISO("ends")} || '"}}' from cross_ where t < ends group by item_id, ends, t)"""


@query("job_feeds_to_log", f"with {_FEED_LOG} select {UUID} event_id, event_type, aggregate_id, content_hash, cast(poll_epoch as bigint) poll_epoch, payload from (select *, {SHA1.format(key="aggregate_id || '|' || event_type || '|' || content_hash || '|' || poll_epoch")} d from feed)")
def _(s, d):
    return feed_log(s, d).select("event_id", "event_type", "aggregate_id", "content_hash", "poll_epoch", "payload")


def _of_kind(kind: str) -> str:
    """Names of the payload fields of a type that is named by one word, quoted."""
    names = sorted({pair.split()[0] for ddl in PAYLOADS.values() for pair in ddl.split(", ") if pair.split()[1] == kind})
    return ", ".join(f"'{n}'" for n in names)


@query("io4_typed_views", f"""with {_FEED_LOG}, fields as (select event_type, unnest(json_keys(payload)) field, payload from feed), vals as (select event_type, field, json_extract_string(payload, '$.' || field) v from fields)
 select event_type, field, count(v) n_present, cast(sum(case when v is null then null when field in ({_of_kind('timestamp')}) then cast(cast(epoch(cast(v as timestamptz)) as bigint) as decimal(38,8)) when field in ({_of_kind('boolean')}) then case v when 'true' then 1 else 0 end when event_type not like 'invoice%' and field not in ({_of_kind('string')}) or (event_type not like 'invoice%' and field = 'amount') then cast(v as decimal(38,8)) else length(v) end) as decimal(38,8)) total from vals group by 1, 2""")
def _(s, d):
    """Every emitted type's payload as typed columns; per field how many there are, and a sum that depends on each."""
    rows, out = log.stable(feed_log(s, d).select("event_type", "payload"), ["event_type"]), None
    for ddl in dict.fromkeys(PAYLOADS.values()):
        view, sums = log.typed(rows, [kind for kind in PAYLOADS if PAYLOADS[kind] == ddl]), []
        for f in StructType.fromDDL(ddl).fields:
            c = F.col(f.name)
            value = F.unix_seconds(c) if isinstance(f.dataType, TimestampType) else F.length(c) if isinstance(f.dataType, StringType) else c.cast("int") if isinstance(f.dataType, BooleanType) else c
            sums.append(F.struct(F.lit(f.name).alias("field"), F.count(c).alias("n_present"), F.sum(value.cast("decimal(38,8)")).cast("decimal(38,8)").alias("total")))
        got = view.groupBy("event_type").agg(F.array(*sums).alias("r")).select("event_type", F.inline("r"))
        out = got if out is None else out.unionByName(got)
    return out


@query("sc3_nested_payload", """select operation_id, amount, '{"account_alias":"acct-' || account_id || '","operation_id":' || operation_id || ',"lot":{"item_id":' || item_id || ',"price":"' || amount || '","seen":"' || strftime(make_timestamp(happened * 1000000), '%Y-%m-%dT%H:%M:%S+00:00') || '","seller":'
 || case when counterparty_id is null then 'null' else '{"id":' || counterparty_id || ',"limits":{"1":"' || cast(amount as decimal(20,8)) || '"}}' end || '},"history":[{"at":"1995-01-01T00:00:00.000500+00:00","price":"' || amount || '"},null],"tags":["a","é",null],"flags":{"True":1}}' payload from {payments}""")
def _(s, d):
    c = F.col
    seller = F.when(c("counterparty_id").isNotNull(), F.struct(c("counterparty_id").alias("id"), F.create_map(F.lit(1), c("amount").cast("decimal(20,8)")).alias("limits")))
    step = F.struct(F.timestamp_micros(F.lit(DAY_ZERO * 1_000_000 + 500)).alias("at"), c("amount").alias("price"))
    rows = load(s, d, "payments").select(
        "operation_id", "amount", F.concat(F.lit("acct-"), "account_id").alias("alias"), F.lit("a tag that the field wins over").alias("other"),
        F.struct("item_id", c("amount").alias("price"), F.timestamp_seconds("happened").alias("seen"), seller.alias("seller")).alias("lot"),
        F.array(step, F.when(F.lit(False), step)).alias("history"), F.array(F.lit("a"), F.lit("é"), F.lit(None)).alias("tags"), F.create_map(F.lit(True), F.lit(1)).alias("flags"),
    )
    return rows.select("operation_id", "amount", pl.encoded(rows, "operation_id", "lot", "history", "tags", "flags", tags={"account_alias": "alias", "lot": "other"}).alias("payload"))


@query("fl6_budget", f"with {_LATEST} select item_id, cast(price as decimal(20,8)) price, poll_epoch from history where event_type = 'new_lot' and category = 'small' and price <= 20000")
def _(s, d):
    return feeds.within_budget(lot_events(s, d), "small", "20000", ["poll_epoch"]).select("item_id", "price", "poll_epoch")


# ---- polls as page files, in the order of the polls

def page_envelopes(s: SparkSession, d: str) -> DataFrame:
    """Pages of 50 lots of every poll, in order of position; a poll that found nothing is one empty page.

    Polls and lots are written first: each of the big exchanges, by item and by poll, is gone before the next."""
    polls = log.stable(load(s, d, "polls").select("category", "poll_epoch"))
    rows = log.stable(load(s, d, "lot_observations").drop("mon"))
    place = F.row_number().over(Window.partitionBy("category", "poll_epoch").orderBy(*POSITION, "item_id")) - 1
    none = lambda kind: F.lit(None).cast(kind)
    item = F.struct("item_id", F.col("content_hash").alias("title"), "price", F.lit("rub").alias("currency"), none("decimal(20,8)").alias("ai_price"), none("timestamp").alias("published_at"), F.lit(1).cast("long").alias("seller_id"), "category")
    pages = rows.withColumn("k", place).groupBy("category", "poll_epoch", (F.floor(F.col("k") / 50) + 1).cast("int").alias("page")).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", item.alias("i")))), lambda x: x["i"]).alias("items"))
    empty = polls.join(rows.select("category", "poll_epoch").distinct(), ["category", "poll_epoch"], "left_anti").select("category", "poll_epoch", F.lit(1).alias("page"), F.array().cast(pages.schema["items"].dataType).alias("items"))
    return pages.unionByName(empty).select("category", F.timestamp_seconds(F.lit(DAY_ZERO) + F.col("poll_epoch") * POLL_SECONDS).alias("captured_at"), "page", F.lit(50).alias("per_page"), "items")


_POLL_EVENTS = f"""{_LATEST}, first_ as (select f.category, count(distinct o.item_id) lot_count from (select category, min(poll_epoch) poll_epoch from {{polls}} group by 1) f left join {{lot_observations}} o using (category, poll_epoch) group by all),
 gone as (select category, item_id, n, row_number() over (partition by category, n order by item_id) k from history where event_type = 'lot_disappeared'),
 why as (select category, item_id, n, case when item_state is null or k > 5 then 'unknown' when item_state = 'closed' then 'delisted' when item_state in ('sold','paid','purchased') then 'sold' else 'unknown' end reason from gone left join {{lot_states}} using (item_id)),
 ev as (select cast(h.item_id as varchar) aggregate_id, h.event_type, case when h.event_type = 'lot_disappeared' then h.content_hash else sha256(h.content_hash || chr(31) || 'rub' || chr(31) || '1') end content_hash, h.n poll_epoch, h.poll_epoch at_epoch,
   '{{"category":"' || h.category || '"' || coalesce(',"price":"' || cast(price as decimal(20,8)) || '"', '') || coalesce(',"old_price":"' || cast(old_price as decimal(20,8)) || '"', '') || coalesce(',"reason":"' || reason || '","confidence":"' || case reason when 'unknown' then 'low' else 'normal' end || '"', '') || '}}' payload
   from history h left join why on h.event_type = 'lot_disappeared' and h.category = why.category and h.item_id = why.item_id and h.n = why.n
   union all select category, 'snapshot_initialized', 'bootstrap:' || lot_count, 1, (select min(poll_epoch) from {{polls}} p where p.category = first_.category), '{{"category":"' || category || '","lot_count":' || lot_count || '}}' from first_),
 ided as (select {UUID} event_id, * from (select *, {SHA1.format(key="aggregate_id || '|' || event_type || '|' || content_hash || '|' || poll_epoch")} d from ev))"""


#: A packed file is read by one task.
PAGES_A_FILE = 20_000
#: Lots that a micro-batch takes, about: what it exchanges and passes on is in proportion to them, not to the history.
LOTS_A_BATCH = 1 << 25


def polls_logged(s: SparkSession, d: str) -> str:
    """The folder of a log that the polls' page files have been streamed to, several polls at a time."""
    folder = streams.shared_folder(s, "ss1")
    states = load(s, d, "lot_states")
    with log.passing(s):
        pages = page_envelopes(s, d).withColumn("at", F.unix_seconds("captured_at"))
        pages.write.option("compression", "zstd").partitionBy("at").parquet(f"{folder}/recorded")
        parts = streams.in_turn(s.read.schema(pages.schema).parquet(f"{folder}/recorded"), "at", F.size("items"), LOTS_A_BATCH)
    for k, part in enumerate(parts):
        part.drop("at").write.option("compression", "gzip").option("maxRecordsPerFile", PAGES_A_FILE).json(f"{folder}/pages/slice={k}")
        arrived = stream_pages(s, f"{folder}/pages/*", files=1 << 20, keep=False)
        arrived.writeStream.foreachBatch(polls_to_log(f"{folder}/log", states)).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    log.delete(s, f"{folder}/recorded")
    return f"{folder}/log"


@query("ss1_polls_to_log", f"with {_POLL_EVENTS} select event_id, event_type, aggregate_id, content_hash, cast(poll_epoch as bigint) poll_epoch, cast({DAY_ZERO} + at_epoch * {POLL_SECONDS} as bigint) occurred_secs, payload from ided")
def _(s, d):
    rows = log.read(s, polls_logged(s, d))
    return rows.select("event_id", "event_type", "aggregate_id", "content_hash", "poll_epoch", F.unix_seconds("occurred_at").alias("occurred_secs"), "payload")


@query("io1_page_files", """select category, item_id, price, title from {lot_observations_titled} union all select 'rejected', null, null, '{"category":"broken' from range(1)""".replace("{lot_observations_titled}", "(select category, item_id, cast(price as decimal(20,8)) price, content_hash title from {lot_observations})"))
def _(s, d):
    """Written as files of page envelopes with a broken line among them, and read again."""
    folder = streams.shared_folder(s, "io1")
    with log.passing(s):
        page_envelopes(s, d).write.json(f"{folder}/pages")
    s.range(1).select(F.lit('{"category":"broken').alias("value")).write.mode("append").text(f"{folder}/pages")
    good, rejected = read_pages(s, f"{folder}/pages")
    bad = rejected.select(F.lit("rejected").alias("category"), F.lit(None).cast("long").alias("item_id"), F.lit(None).cast("decimal(20,8)").alias("price"), F.col("text").alias("title"))
    return lots_of(good).select("category", "item_id", "price", "title").unionByName(bad)


@query("io2_feed_files", "select kind, notification_id, content_type, extra from {notifications} union all select 'rejected', null, null, x from (values ('[1'), ('{\"notification_id\":7}')) t(x)")
def _(s, d):
    """A feed as JSON lines, with fields that nobody asked for, a broken line and one without its kind."""
    folder = streams.shared_folder(s, "io2")
    load(s, d, "notifications").withColumn("other", F.lit(1)).write.json(f"{folder}/feed")
    s.createDataFrame([("[1",), ('{"notification_id":7}',)], "value string").write.mode("append").text(f"{folder}/feed")
    good, rejected = read_feed(s, f"{folder}/feed", NOTIFICATION)
    none = F.lit(None).cast("string")
    bad = rejected.select(F.lit("rejected").alias("kind"), F.lit(None).cast("long").alias("notification_id"), none.alias("content_type"), F.col("text").alias("extra"))
    return good.select("kind", "notification_id", "content_type", "extra").unionByName(bad)


@query("ss6_poison", "select seq, seq % 97 = 0 parked from {event_log}")
def _(s, d):
    rows = stored(s, d).select("seq", F.col("event_id"), "payload")
    handler = lambda df: df.withColumn("error", F.when(F.col("seq") % 97 == 0, "boom"))
    return streams.run_batches(rows, lambda done, parked: jobs.handled(handler, parked, done, 2), "ss6").select("seq", "parked")


@query("ss5_ss7_subscribed", "select seq from {event_log} where seq > 300 and event_type in ('new_lot', 'lot_updated') and category = 'small'")
def _(s, d):
    return streams.run(slim(s, d), lambda log_: jobs.subscribed(log_, ["new_lot", "lot_updated"], {"category": "small"}, 300), "ss7").select("seq")
