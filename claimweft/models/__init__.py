"""Ports for models, and deterministic rules that stand in for them offline. The rules are heuristics, not models."""
