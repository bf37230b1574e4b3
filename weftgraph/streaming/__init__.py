"""Continuous ingest of documents."""
