"""Readers of tables, pre-fetched pages and provider replies."""
