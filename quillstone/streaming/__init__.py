"""Continuous ingestion into a store."""
