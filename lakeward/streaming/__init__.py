"""Incremental forms of ingestion and materialized views."""
