"""Outbox, delivery outcomes, retry times and dead letters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tidelog.functions.payload import canonical_json, iso, sign


def with_body(events: DataFrame) -> DataFrame:
    """Adds the canonical envelope; do it once per event, before fan-out."""
    return events.withColumn("body", canonical_json("payload", "event_id", "event_type", "aggregate_id", iso(F.col("occurred_at")), "seq", "schema_version"))


def outbox(deliveries: DataFrame) -> DataFrame:
    """One row per subscription and event with endpoint, body and headers; needs inner and outer pads."""
    signature = sign(F.col("body"), F.col("inner"), F.col("outer"))
    headers = F.create_map(F.lit("X-Event-Id"), "event_id", F.lit("X-Event-Type"), "event_type", F.lit("X-Signature"), signature, F.lit("Idempotency-Key"), "event_id", F.lit("Content-Type"), F.lit("application/json"))
    return deliveries.select("consumer_name", "seq", "endpoint", "body", headers.alias("headers"))


def sse_frames(events: DataFrame) -> DataFrame:
    """Text frames in seq order; other characters stay as they are."""
    return events.select("seq", F.format_string("id: %d\nevent: %s\ndata: %s\n\n", "seq", "event_type", "data").alias("frame")).orderBy("seq")


def classified(attempts: DataFrame) -> DataFrame:
    """Adds result (delivered, terminal, retry) and reason to attempts (status, ok, error). An
    endpoint that isn't safe to call ends the matter; other errors are tried again."""
    good = F.col("status").between(200, 299)
    retry = (F.col("status") >= 500) | F.col("status").isin(408, 429)
    refused = F.coalesce(~F.col("ok"), F.lit(False))
    unsafe = F.col("error").startswith("unsafe_url:")
    result = F.when(unsafe, "terminal").when(F.col("error").isNotNull(), "retry").when(good & ~refused, "delivered").when(good | retry, "retry").otherwise("terminal")
    reason = F.when(F.col("error").isNotNull(), F.col("error")).when(good & refused, "receiver_requested_retry").when(~good, F.concat(F.lit("http_"), F.col("status")))
    return attempts.withColumn("result", result).withColumn("reason", reason)


def outcomes(attempts: DataFrame, most: int) -> DataFrame:
    """Per subscription and event: delivered, dead (with the last reason) or pending, and the attempts that count."""
    rows = classified(attempts.where(F.col("attempt") <= most))
    key = ["consumer_name", "seq"]
    ends = rows.groupBy(*key).agg(F.min(F.when(F.col("result") != "retry", F.col("attempt"))).alias("_end"))
    live = rows.join(ends, key).where(F.col("_end").isNull() | (F.col("attempt") <= F.col("_end")))
    done = live.groupBy(*key).agg(F.max_by("result", "attempt").alias("_last"), F.max_by("reason", "attempt").alias("_reason"), F.count("*").alias("n_attempts"))
    out = F.when(F.col("_last") == "delivered", "delivered").when((F.col("_last") == "terminal") | (F.col("n_attempts") >= most), "dead").otherwise("pending")
    return done.select(*key, out.alias("outcome"), F.when(out == "dead", F.col("_reason")).alias("reason"), "n_attempts")


def retry_schedule(attempts: DataFrame, base: float, most_wait: float, cap: float, most: int) -> DataFrame:
    """The wait after each attempt that is tried again, and the time waited so far.

    Failures double the wait; a receiver that asks for another try sets it itself, up to ``cap``,
    without doubling. There is no wait after the last attempt."""
    rows = classified(attempts)
    # taken by a generator: a filter would go down to the tables with all that its columns are made of,
    # each as often as it is used, in code too long to be compiled
    again = F.explode(F.when(F.col("result") == "retry", F.array("reason")))
    rows = rows.select(*[c for c in rows.columns if c != "reason"], again.alias("reason"))
    order = Window.partitionBy("consumer_name", "seq").orderBy("attempt")
    paced = F.col("reason") == "receiver_requested_retry"
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_k", F.coalesce(F.sum(F.when(paced, 0).otherwise(1)).over(before), F.lit(0)))
    asked = F.when(F.col("retry_after") > 0, F.col("retry_after")).otherwise(F.lit(base))
    wait = F.when(F.col("attempt") >= most, 0.0).when(paced, F.least(asked, F.lit(cap))).otherwise(F.least(F.lit(base) * F.pow(F.lit(2.0), F.col("_k")), F.lit(most_wait)))
    return rows.withColumn("wait", wait.cast("double")).withColumn("waited", F.sum("wait").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_k")


def bus_wait(attempt, base: float, most_wait: float):
    return F.least(F.lit(base) * F.pow(F.lit(2.0), attempt), F.lit(most_wait))


def dead_letters(outcome: DataFrame, events: DataFrame) -> DataFrame:
    """Dead deliveries with their events: consumer_name, seq, event_id, reason and what an event is made of."""
    rows = events.select("seq", "event_id", "event_type", "aggregate_id", "occurred_at", "content_hash", "schema_version", "payload")
    return outcome.where("outcome = 'dead'").join(rows, "seq").select("consumer_name", *rows.columns, "reason")


def dead_list(dead: DataFrame) -> DataFrame:
    """Each consumer's dead letters in order of seq, with their place (from 1)."""
    return dead.withColumn("place", F.row_number().over(Window.partitionBy("consumer_name").orderBy("seq")))


def dead_counts(dead: DataFrame) -> DataFrame:
    return dead.groupBy("consumer_name").agg(F.count("*").alias("n_dead"))
