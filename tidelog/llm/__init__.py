"""Training-data operators: deduplication, filters, scoring, packing and token storage."""
