"""Structured Streaming forms of the ingestion, drift and quality operators."""
