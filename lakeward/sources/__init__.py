"""Readers: files, databases, catalog tables, generated rows."""
