"""Expressions and per-text functions."""
