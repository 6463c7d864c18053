"""Staging views, marts and the queries built from them."""
