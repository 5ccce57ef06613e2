"""Keyed state over unbounded inputs with Structured Streaming."""
