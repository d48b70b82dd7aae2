"""Domain tables derived from the driver's tables, in SQL that Spark and DuckDB both read.

Times are unix seconds. ``{name}`` stands for another table; ``epoch(x)`` is the only
function that differs between the two."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from tidelog.operators.log import positions
from tidelog.schemas import PAYMENT_EVENTS

_OPERATIONS = [*PAYMENT_EVENTS, "cashback", "bonus"]
_OPERATION = "case o_orderkey % 14 " + " ".join(f"when {i} then '{x}'" for i, x in enumerate(_OPERATIONS)) + " end"
_PAYMENT = f"""select o_orderkey as operation_id, o_custkey % 20 as account_id, {_OPERATION} as operation_type, cast(o_totalprice as decimal(18,2)) as amount,
    case when o_custkey % 11 = 0 then null else o_custkey end as counterparty_id, o_orderstatus = 'P' as is_hold,
    case when o_orderstatus = 'P' then epoch(o_orderdate) + 86400 else 0 end as hold_end_date, o_orderkey % n_parts as item_id, epoch(o_orderdate) as happened,
    'rub' as currency, 'user-' || cast(o_custkey as string) as counterparty_username, cast(o_orderkey % 5 as int) as fee, o_orderpriority as comment
    from {{orders}} cross join (select count(*) as n_parts from {{part}}) p"""

TABLES: dict[str, str] = {
    "lot_all": """select lower(p_type) as category, l_partkey as item_id, cast((year(l_shipdate) - 1995) * 12 + month(l_shipdate) as bigint) as mon,
        cast(l_extendedprice as decimal(18,2)) as price, l_returnflag || ':' || l_linestatus as content_hash, l_shipdate, l_orderkey, l_linenumber, l_suppkey
        from {lineitem} join {part} on l_partkey = p_partkey""",
    "lot_observations": "select *, case when category = 'economy' then 2 * mon else mon end as poll_epoch from {lot_all} where not (category = 'promo' and mon % 17 = 0)",
    "polls": """select c.category, m.mon, case when c.category = 'economy' then 2 * m.mon else m.mon end as poll_epoch
        from (select category, min(mon) as lo from {lot_all} group by category) c join (select distinct mon from {lot_all}) m on m.mon >= c.lo""",
    "lot_states": "select p_partkey as item_id, case p_partkey % 5 when 1 then 'closed' when 2 then 'sold' when 3 then 'paid' else 'active' end as item_state from {part} where p_partkey % 5 <> 0",
    "lots": """select lower(p_type) as category, p_partkey as item_id, cast(p_retailprice as decimal(18,2)) as price, p_name as title, 788918400 + 86400 * p_partkey as published_at, p_brand as game,
        cast(cast(p_retailprice as decimal(18,2)) * cast(9 + p_size % 5 as decimal(4,0)) * cast(0.1 as decimal(2,1)) as decimal(20,3)) as ai_price from {part}""",
    "payments": f"select * from ({_PAYMENT}) a union all select * from ({_PAYMENT}) b where operation_id % 10 = 0 union all select operation_id, account_id, operation_type, cast(amount + 1 as decimal(18,2)), counterparty_id, is_hold, hold_end_date, item_id, happened, currency, counterparty_username, fee, comment from ({_PAYMENT}) c where operation_id % 25 = 0",
    "payment_marks": "select account_id, cast(floor(max(operation_id) / 2) as bigint) as mark from {payments} where account_id % 4 <> 0 group by account_id",
    "notifications": """select case when event_id % 3 = 0 then 'nomarket' else 'market' end as kind, event_id as notification_id,
        case event_type when 'click' then 'market_dispute_opened' when 'error' then 'market_claim_filed' when 'purchase' then 'market_lot_reserved' when 'signup' then 'market_purchase_confirmed' else 'market_new_review' end as content_type,
        epoch(ts) as created_at,
        case event_id % 5 when 0 then '{}' when 1 then '{"claim_id":' || cast(event_id + 7 as string) || ',"item_id":' || cast(user_id as string) || '}' when 2 then '{"claim_id":null,"item_id":null}'
          when 3 then '{"item_id":' || cast(user_id as string) || ',"buyer_id":' || cast(event_id + 9 as string) || '}' else '{"claim_id":"x7"}' end as extra from {events}""",
    "messages": "select conv_id as conversation_id, conv_id * 1000 + turn as message_id, turn, role = 'system' as is_system, text from {conversations}",
    "chats": "select conv_id as conversation_id, max(turn) as conversation_update_date, conv_id % 3 = 0 as is_unread from {conversations} group by conv_id",
    "chat_marks": "select distinct conv_id as conversation_id, conv_id * 1000 + conv_id % 4 as mark from {conversations}",
    "chats_known": "select distinct conv_id as conversation_id from {conversations} where conv_id % 5 <> 0",
    "chats_updated": "select conv_id as conversation_id, max(turn) as conversation_update_date from {conversations} where conv_id % 2 = 0 group by conv_id",
    "profiles": """select user_id, poll, cast(sum(likes) over (partition by user_id order by poll) as bigint) as user_like_count, cast(sum(dislikes) over (partition by user_id order by poll) as bigint) as user_dislike_count
        from (select user_id, cast(floor(epoch(ts) / 86400) as bigint) as poll, sum(case when event_type = 'purchase' then 1 else 0 end) as likes, sum(case when event_type = 'error' then 1 else 0 end) as dislikes from {events} group by user_id, cast(floor(epoch(ts) / 86400) as bigint)) d""",
    "accounts": "select distinct c_custkey % 20 as account_id, 'acct-' || cast(c_custkey % 20 as string) as alias, c_custkey % 20 <> 7 as is_primary from {customer}",
    "purchases": "select operation_id as item_id, happened, operation_id % 11 = 0 as vague, operation_id % 9 = 0 as no_lot, happened + (operation_id % 72) * 3600 as ends from (select distinct operation_id, happened from {payments} where operation_type = 'paid_item') p",
    "watched": "select item_id, happened, ends from {purchases} where not vague and not no_lot",
    "invoices": """select 'inv-' || cast(o_orderkey as string) as invoice_id, case when o_orderkey % 20 = 0 then 'refunded' when o_orderstatus = 'F' then 'paid' when o_orderstatus = 'O' then 'created' else 'expired' end as status,
        case when o_orderkey % 2 = 0 then null when o_orderkey % 3 = 0 then '' else 'evt-' || cast(o_orderkey as string) end as event_id from {orders}""",
    "numbered": "select *, row_number() over (order by ts, event_id) as seq from {events}",
    "event_log": """select seq, event_id as raw_id, case event_type when 'click' then 'new_lot' when 'view' then 'price_dropped' when 'purchase' then 'lot_updated' when 'error' then 'lot_disappeared' else 'rating_changed' end as event_type,
        cast(user_id as string) as aggregate_id, epoch(ts) as happened, cast(1 as int) as schema_version, cast(seq as string) as content_hash, cast(floor(seq / 1000) as bigint) as poll_epoch,
        case when event_type in ('click','view','purchase','error') then '{"category":"' || case user_id % 6 when 0 then 'standard' when 1 then 'small' when 2 then 'medium' when 3 then 'large' when 4 then 'economy' else 'promo' end || '"}' else '{"account_alias":"acct-' || cast(user_id as string) || '"}' end as payload,
        case when event_type in ('click','view','purchase','error') then case user_id % 6 when 0 then 'standard' when 1 then 'small' when 2 then 'medium' when 3 then 'large' when 4 then 'economy' else 'promo' end end as category,
        case when event_type not in ('click','view','purchase','error') then 'acct-' || cast(user_id as string) end as account_alias from {numbered}""",
    "subscriptions": """select 'sink:' || cast(c_custkey as string) as consumer_name, c_custkey, case c_custkey % 4 when 0 then 'webhook' when 1 then 'polling' when 2 then 'sse' else 'ws' end as transport,
        case c_custkey % 5 when 0 then 'new_lot' when 1 then 'new_lot,price_dropped' when 2 then 'rating_changed' when 3 then 'lot_updated,lot_disappeared,rating_changed' else 'price_dropped,no_such_event' end as type_list,
        case when c_custkey < 6 then 'none' when c_custkey < 30 then 'category' else 'account' end as scope_kind,
        case when c_custkey >= 6 and c_custkey < 30 then case c_custkey % 6 when 1 then 'small' when 2 then 'large' else 'economy' end end as category,
        case when c_custkey >= 30 then 'acct-' || cast(cast(floor(c_custkey / 10) as bigint) as string) end as account_alias, c_acctbal >= 0 as active, c_custkey % 2 = 1 as backfill from {customer}""",
    "cursor_log": """select 'sink:' || cast(c_custkey as string) as consumer_name, cast(v as bigint) as version, cast(case when v = c_custkey % 4 + 1 then last else floor(last * v / 5) end as bigint) as last_seq
        from (select c_custkey, head - (c_custkey * 37) % cast(floor(head / 2) + 1 as bigint) as last from {customer} cross join (select count(*) as head from {events}) h) c cross join (select 1 as v union all select 2 union all select 3 union all select 4) n where c_custkey % 13 <> 0 and v <= c_custkey % 4 + 1""",
    "cursors": "select consumer_name, last_seq from (select *, row_number() over (partition by consumer_name order by version desc) as k from {cursor_log}) x where k = 1",
    "type_names": "select 'new_lot' as event_type union all select 'price_dropped' union all select 'rating_changed' union all select 'lot_updated' union all select 'lot_disappeared' union all select 'no_such_event'",
    "asked": """select s.*, t.event_type from {subscriptions} s join {type_names} t on ',' || s.type_list || ',' like '%,' || t.event_type || ',%' where s.active""",
    "matched": """select s.consumer_name, s.c_custkey, l.seq, l.event_type, l.payload, l.aggregate_id, l.happened from {event_log} l join {asked} s on l.event_type = s.event_type and l.account_alias = s.account_alias where s.scope_kind = 'account'
        union all select s.consumer_name, s.c_custkey, l.seq, l.event_type, l.payload, l.aggregate_id, l.happened from {event_log} l join {asked} s on l.event_type = s.event_type and l.category = s.category where s.scope_kind = 'category'
        union all select s.consumer_name, s.c_custkey, l.seq, l.event_type, l.payload, l.aggregate_id, l.happened from {event_log} l join {asked} s on l.event_type = s.event_type where s.scope_kind = 'none'""",
    "attempts": """select consumer_name, seq, cast(a as bigint) as attempt, case (seq * 7 + c_custkey * 3 + a) % 10 when 0 then 200 when 1 then 200 when 2 then 500 when 3 then 429 when 4 then 404 when 5 then null when 6 then 503 when 7 then 200 when 8 then 500 else 408 end as status,
        case when (seq * 7 + c_custkey * 3 + a) % 10 = 1 then false when (seq * 7 + c_custkey * 3 + a) % 10 = 0 then true end as ok, case when (seq * 7 + c_custkey * 3 + a) % 10 = 5 then case when seq % 3 = 0 then 'unsafe_url:private' else 'timeout' end end as error,
        case when (seq * 7 + c_custkey * 3 + a) % 10 = 1 then cast(seq % 40 as double) end as retry_after
        from {matched} cross join (select 1 as a union all select 2 union all select 3 union all select 4 union all select 5) n""",
}

_NAME = re.compile(r"\{(\w+)\}")


def needed(sql: str) -> list[str]:
    """Domain tables that a text uses, each after those it uses itself."""
    out: list[str] = []
    for name in _NAME.findall(sql):
        if name in TABLES:
            for n in [*needed(TABLES[name]), name]:
                if n not in out:
                    out.append(n)
    return out


def duckdb_sql(body: str) -> str:
    """``body`` with the domain tables it needs as common table expressions."""
    plain = lambda s: _NAME.sub(r"\1", re.sub(r"epoch\(([^()]*)\)", r"cast(floor(epoch(\1)) as bigint)", s))
    tables = ", ".join(f"{n} as ({plain(TABLES[n])})" for n in needed(body))
    body = plain(body)
    if not tables:
        return body
    return f"with {tables}, {body.lstrip()[5:]}" if body.lstrip().lower().startswith("with ") else f"with {tables} {body}"


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table or a domain table as a DataFrame."""
    if name not in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    if name == "numbered":
        return positions(load(spark, sf_dir, "events"), ["ts", "event_id"], "seq")
    sql = re.sub(r"epoch\(([^()]*)\)", r"unix_seconds(cast(\1 as timestamp))", TABLES[name])
    parts = {n: load(spark, sf_dir, n) for n in set(_NAME.findall(sql))}
    # curly brackets in JSON texts aren't names
    for n in parts:
        sql = sql.replace("{" + n + "}", f"<<{n}>>")
    sql = sql.replace("{", "{{").replace("}", "}}")
    for n in parts:
        sql = sql.replace(f"<<{n}>>", "{" + n + "}")
    return spark.sql(sql, **parts)
