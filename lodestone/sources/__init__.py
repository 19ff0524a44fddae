"""Readers of documents."""
