"""Streaming ingestion of generated batches."""
