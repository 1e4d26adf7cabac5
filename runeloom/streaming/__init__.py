"""Stateless streams of tool events."""
