"""Readers of the parquet tables, and adapters that turn them into operation logs, entries and telemetry."""
