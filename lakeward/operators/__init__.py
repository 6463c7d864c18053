"""Relational operators over whole tables."""
