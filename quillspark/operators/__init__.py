"""Relational building blocks of the retrieval flows."""
