"""Payloads, envelopes, signatures and times."""

from __future__ import annotations

import json
from collections.abc import Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tidelog.schemas import SOLD_STATES


def iso(ts: Column) -> Column:
    """ISO-8601 text in UTC; microseconds only where there are any."""
    micros = F.date_format(ts, "SSSSSS")
    return F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), F.when(micros != "000000", F.concat(F.lit("."), micros)).otherwise(""), F.lit("+00:00"))


def jsonable(value: Column, kind: T.DataType) -> Column:
    """``value`` with money, times and other kinds that JSON lacks as text, at any depth of structs, arrays and maps.

    Decimals keep their digits, times are ISO-8601 in UTC, dates and fractions their text, keys of
    maps their text; null stays null. Binary values have no text and are an error."""
    if isinstance(kind, (T.StringType, T.IntegralType, T.BooleanType, T.NullType)):
        return value
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return iso(value)
    if isinstance(kind, (T.DecimalType, T.DateType, T.FractionalType)):
        return value.cast("string")
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: jsonable(x, kind.elementType))
    if isinstance(kind, T.MapType):
        keyed = F.transform_keys(value, lambda k, _: map_key(k, kind.keyType))
        return F.transform_values(keyed, lambda _, v: jsonable(v, kind.valueType))
    if isinstance(kind, T.StructType):
        fields = [jsonable(value.getField(f.name), f.dataType).alias(f.name) for f in kind.fields]
        return F.when(value.isNotNull(), F.struct(*fields)) if fields else value
    raise TypeError(f"no JSON for {kind.simpleString()}")


def map_key(key: Column, kind: T.DataType) -> Column:
    """A key as text: a time with a blank for its T, a truth value with a capital."""
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.regexp_replace(iso(key), "T", " ")
    return F.initcap(key.cast("string")) if isinstance(kind, T.BooleanType) else key.cast("string")


def encoded(rows: DataFrame, *fields: str, tags: Mapping[str, str] | None = None) -> Column:
    """The payload of an event: columns ``tags`` (by name) and then ``fields`` of ``rows`` as one JSON object.

    A field wins over a tag of its name; a tag without a value is left out, a field's null stays."""
    kinds = {f.name: f.dataType for f in rows.schema.fields}
    own = F.to_json(F.struct(*[jsonable(F.col(c), kinds[c]).alias(c) for c in fields]), {"ignoreNullFields": "false"}) if fields else F.lit("{}")
    marks = {k: c for k, c in (tags or {}).items() if k not in fields}
    if not marks:
        return own
    first = F.to_json(F.struct(*[jsonable(F.col(c), kinds[c]).alias(k) for k, c in marks.items()]))
    between = F.when((first == "{}") | (own == "{}"), "").otherwise(",")
    return F.concat(F.expr("'{'"), F.substr(first, F.lit(2), F.length(first) - 2), between, F.substr(own, F.lit(2)))


def payload(**fields: Column) -> Column:
    """One JSON object of declared fields; nulls stay. Cast money to text before."""
    return F.to_json(F.struct(*[c.alias(k) for k, c in fields.items()]), {"ignoreNullFields": "false"})


def tags(**fields: Column) -> Column:
    """A JSON object of tags; a tag without a value is left out."""
    return F.to_json(F.struct(*[c.alias(k) for k, c in fields.items()]))


def unix_time(seconds: Column) -> Column:
    """Seconds to a timestamp; null and 0 give null."""
    return F.timestamp_seconds(F.nullif(seconds, F.lit(0).cast("long")))


def guarantee_time(text: Column) -> Column:
    """ISO-8601 text to a timestamp (without a zone: UTC); anything else gives null."""
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}.*)?$"), F.try_to_timestamp(text))


def resolve_reason(item_state: Column, found: Column) -> Column:
    """Why a lot is gone, and how urgent that is: struct(reason, confidence)."""
    reason = F.when(~found, "unknown").when(item_state == "closed", "delisted").when(item_state.isin(SOLD_STATES), "sold").otherwise("unknown")
    return F.struct(reason.alias("reason"), F.when(reason == "unknown", "low").otherwise("normal").alias("confidence"))


@F.pandas_udf(T.StringType())
def canonical_json(body: pd.Series, event_id: pd.Series, event_type: pd.Series, aggregate_id: pd.Series, occurred_at: pd.Series, seq: pd.Series, schema_version: pd.Series) -> pd.Series:
    """Payload and six envelope fields (which win), keys sorted, no blanks, ASCII only.

    Built-in JSON functions neither sort keys nor escape other characters."""
    out = []
    for b, *own in zip(body, event_id, event_type, aggregate_id, occurred_at, seq.tolist(), schema_version.tolist()):
        data = json.loads(b) if b else {}
        data.update(zip(("event_id", "event_type", "aggregate_id", "occurred_at", "seq", "schema_version"), own))
        out.append(json.dumps(data, separators=(",", ":"), sort_keys=True))
    return pd.Series(out)


def _xor_pad(words: Column, with_byte: int) -> Column:
    """64 bytes, given as eight longs, each combined with one byte, as binary (built-in functions only)."""
    mask = F.lit(int.from_bytes(bytes([with_byte] * 8), "big", signed=True))
    return F.unhex(F.array_join(F.transform(words, lambda w: F.lpad(F.hex(w.bitwiseXOR(mask)), 16, "0")), ""))


def with_pads(rows, secret: str):
    """Add ``inner`` and ``outer`` for the column ``secret``; do this once per secret, before fan-out."""
    raw = F.encode(F.coalesce(F.col(secret), F.lit("")), "UTF-8")
    key = F.rpad(F.lower(F.when(F.length(raw) > 64, F.sha2(raw, 256)).otherwise(F.hex(raw))), 128, "0")
    words = F.array(*[F.conv(F.substring("_key", 16 * i + 1, 16), 16, -10).cast("long") for i in range(8)])
    return rows.withColumn("_key", key).withColumn("_key", words).withColumn("inner", _xor_pad(F.col("_key"), 0x36)).withColumn("outer", _xor_pad(F.col("_key"), 0x5C)).drop("_key")


def sign(body: Column, inner: Column, outer: Column) -> Column:
    """HMAC-SHA256 of a UTF-8 body as ``sha256=<hex>``."""
    first = F.unhex(F.sha2(F.concat(inner, F.encode(body, "UTF-8")), 256))
    return F.concat(F.lit("sha256="), F.sha2(F.concat(outer, first), 256))


def verify(header: Column, body: Column, inner: Column, outer: Column) -> Column:
    """False without a header, without its prefix, or when it differs."""
    return F.coalesce(header == sign(body, inner, outer), F.lit(False))


def pack_dead_letter(event_type: Column, aggregate_id: Column, occurred_at: Column, content_hash: Column, schema_version: Column, payload_: Column) -> Column:
    """A parked event as one JSON text: ``_meta`` with what its payload doesn't hold, and the payload.
    Consumer, number, event id and reason are columns beside it."""
    meta = F.to_json(F.struct(event_type.alias("event_type"), aggregate_id.alias("aggregate_id"), iso(occurred_at).alias("occurred_at"), content_hash.alias("content_hash"), schema_version.alias("schema_version")), {"ignoreNullFields": "false"})
    return F.concat(F.lit('{"_meta":'), meta, F.lit(',"payload":'), F.coalesce(payload_, F.lit("{}")), F.lit("}"))


def unpack_dead_letter(packed: Column) -> list[Column]:
    """The event's columns again."""
    get = lambda k: F.get_json_object(packed, f"$._meta.{k}")
    return [
        get("event_type").alias("event_type"), get("aggregate_id").alias("aggregate_id"), F.to_timestamp(get("occurred_at")).alias("occurred_at"),
        get("content_hash").alias("content_hash"), get("schema_version").cast("int").alias("schema_version"), F.get_json_object(packed, "$.payload").alias("payload"),
    ]
