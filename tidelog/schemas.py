"""Fixed schemas, event types and dispatch tables."""

from __future__ import annotations

MONEY = "decimal(20,8)"

LOT = f"item_id long, category string, price {MONEY}, currency string, title string, seller_id long, published_at timestamp, ai_price {MONEY}"
PAGE = f"category string, captured_at timestamp, page int, per_page int, items array<struct<item_id:long,title:string,price:{MONEY},currency:string,ai_price:{MONEY},published_at:timestamp,seller_id:long,category:string>>"
PAYMENT = f"operation_id long, operation_type string, amount {MONEY}, currency string, counterparty_id long, counterparty_username string, fee int, is_hold boolean, hold_end_date long, item_id long, comment string"
NOTIFICATION = "kind string, notification_id long, content_type string, created_at long, extra string"
CONVERSATION = "conversation_id long, conversation_title string, creator_user_id long, creator_username string, conversation_update_date long, is_unread boolean, folder string"
MESSAGE = "message_id long, conversation_id long, creator_user_id long, message_body_plain_text string, message_create_date long, message_is_system boolean"
PROFILE = "user_id long, username string, user_like_count int, user_dislike_count int"
INVOICE = "invoice_id string, status string, event_id string, amount string, currency string"

#: A row of the event log without its number.
EVENT_COLUMNS = ["event_id", "event_type", "schema_version", "aggregate_id", "occurred_at", "content_hash", "payload", "poll_epoch"]

# Names of events, operations, notifications and states, and their pairings.
CATALOG_EVENTS = ["new_lot", "price_dropped", "lot_updated", "lot_disappeared", "snapshot_initialized"]
ACCOUNT_EVENTS = ["rating_changed"]
PAYMENT_EVENTS = {
    "income": "income_received",
    "expense": "expense_recorded",
    "refill": "balance_refilled",
    "withdraw": "balance_withdrawn",
    "paid_item": "item_purchased",
    "sold_item": "item_sold",
    "transfer_to": "money_transferred",
    "transfer_from": "money_received",
    "internal_purchase": "internal_purchase",
    "hold_claimed": "hold_claimed",
    "auto_payment": "auto_payment_triggered",
    "exchange": "balance_exchanged",
}
NOTIFICATION_EVENTS = {
    "market_dispute_opened": "dispute_opened",
    "market_claim_filed": "claim_filed",
    "market_lot_reserved": "lot_reserved",
    "market_purchase_confirmed": "purchase_confirmed",
}
NOTIFICATION_FALLBACKS = {"market": "market_notification_received", "nomarket": "forum_notification_received"}
INVOICE_EVENTS = {"paid": "invoice_paid", "created": "invoice_created", "expired": "invoice_expired"}
RESERVED_EVENTS = [
    "payout_requested", "transfer_held", "transfer_cancelled", "account_invalid", "reserve_expired", "purchase_cancelled",
    "deal_detected", "price_vs_ai_changed", "inventory_revalued", "discount_requested", "discount_approved", "discount_declined",
]
EVENT_TYPES = [
    *CATALOG_EVENTS, *PAYMENT_EVENTS.values(), *NOTIFICATION_EVENTS.values(), *NOTIFICATION_FALLBACKS.values(),
    *INVOICE_EVENTS.values(), "new_conversation", "new_message", "rating_changed", "guarantee_expiring", *RESERVED_EVENTS,
]
SOLD_STATES = ["sold", "paid", "purchased"]
EVENT_NAMESPACE = "6f9619ff8b86d011b42d00cf4fc964ff"
DISAPPEAR_POLLS = 3
CONFIRM_CAP = 5
GUARANTEE_WINDOWS = {"24h": 86400, "6h": 21600, "1h": 3600}
SEEN_SECONDS = 86400
DEAL_THRESHOLD = "0.85"
LAG_ALARM = 100_000

_OPERATION = "operation_id long, amount decimal(20,8), currency string, counterparty_id long, counterparty_username string, fee int, is_hold boolean, hold_end_date timestamp, item_id long, comment string"
_MARKED = "notification_id long, content_type string, created_at timestamp"
_BILL = "invoice_id string, status string, amount string, currency string"
#: The typed fields of each emitted event's payload.
PAYLOADS = {
    "new_lot": "category string, price decimal(20,8)",
    "price_dropped": "category string, old_price decimal(20,8), price decimal(20,8)",
    "lot_updated": "category string, price decimal(20,8)",
    "lot_disappeared": "category string, reason string, confidence string",
    "snapshot_initialized": "category string, lot_count long",
    **{kind: _OPERATION for kind in PAYMENT_EVENTS.values()},
    "dispute_opened": "claim_id long, item_id long",
    "claim_filed": "claim_id long, item_id long",
    "lot_reserved": "item_id long, buyer_id long",
    "purchase_confirmed": "item_id long, buyer_id long",
    **{kind: _MARKED for kind in NOTIFICATION_FALLBACKS.values()},
    **{kind: _BILL for kind in INVOICE_EVENTS.values()},
    "new_conversation": "conversation_id long, conversation_title string, creator_user_id long, creator_username string, folder string",
    "new_message": "message_id long, conversation_id long, author_user_id long, message_text string, is_system boolean, folder string",
    "rating_changed": "account_alias string, user_like_count int, user_dislike_count int, delta_likes int, delta_dislikes int",
    "guarantee_expiring": "item_id long, guarantee_end timestamp",
}
