"""Incremental, resumable ingestion."""
