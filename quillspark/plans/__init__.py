"""Flows: ingestion, index maintenance, retrieval, evaluation."""
