"""Deterministic event ids and content hashes (built-in functions only)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tidelog.schemas import EVENT_NAMESPACE


def event_id(aggregate_id: Column, event_type: Column, content_hash: Column, poll_epoch: Column) -> Column:
    """uuid5 of ``aggregate|type|hash|epoch`` in the fixed namespace, as 36 characters; null if a part is."""
    bar = F.lit("|")
    key = F.concat(aggregate_id.cast("string"), bar, event_type, bar, content_hash, bar, poll_epoch.cast("string"))
    digest = F.sha1(F.concat(F.unhex(F.lit(EVENT_NAMESPACE)), F.encode(key, "UTF-8")))
    cut = lambda a, n: F.substring(digest, a, n)
    variant = F.translate(cut(17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    return F.concat(cut(1, 8), F.lit("-"), cut(9, 4), F.lit("-5"), cut(14, 3), F.lit("-"), variant, cut(18, 3), F.lit("-"), cut(21, 12))


def payment_hash(operation_id: Column, operation_type: Column, amount_text: Column) -> Column:
    """Digest of ``id:type:amount``; a null part reads None, as no part's text is."""
    text = lambda c: F.coalesce(c.cast("string"), F.lit("None"))
    return F.sha2(F.concat(text(operation_id), F.lit(":"), text(operation_type), F.lit(":"), text(amount_text)), 256)


def fields_hash(*fields: Column) -> Column:
    """Digest over the meaningful fields only; a null differs from an empty text."""
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(f.cast("string"), F.lit("\x00")) for f in fields]), 256)


def keyed_hash(*parts: str | Column) -> Column:
    """Text keys such as ``gone:42``: parts joined by colons."""
    return F.concat_ws(":", *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
