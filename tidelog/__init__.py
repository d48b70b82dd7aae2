"""Snapshot diffing, typed event derivation and a numbered event log as Spark jobs."""
