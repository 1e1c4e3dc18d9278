"""Readers, cleaning rules and table writers."""
