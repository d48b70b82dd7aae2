"""Handlers on slices of the event stream, and sources that join the log."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F

from tidelog.operators.consume import payload_matches
from tidelog.operators.log import one_log

Handler = Callable[[DataFrame], DataFrame]


@dataclass
class Router:
    """``on`` registers a handler for types and payload filters; each gets every event that matches."""

    handlers: list[tuple[frozenset[str], dict[str, str], Handler]] = field(default_factory=list)

    def on(self, *event_types: str, filters: Mapping[str, str] | None = None) -> Callable[[Handler], Handler]:
        if not event_types:
            raise ValueError("a handler needs an event type")

        def add(handler: Handler) -> Handler:
            self.handlers.append((frozenset(event_types), dict(filters or {}), handler))
            return handler

        return add

    def handle(self, events: DataFrame) -> list[DataFrame]:
        out = []
        for types, filters, handler in self.handlers:
            asked = F.create_map(*[F.lit(x) for pair in filters.items() for x in pair]) if filters else F.create_map().cast("map<string,string>")
            out.append(handler(events.where(F.col("event_type").isin(sorted(types)) & payload_matches(F.col("payload"), asked))))
        return out


def collect_sources(*sources: Callable[[], DataFrame]) -> DataFrame:
    """Events of any callables that return an event frame, in one checked schema."""
    return one_log(*[source() for source in sources])
