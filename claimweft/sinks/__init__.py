"""Sinks: log text, JSON replies."""
