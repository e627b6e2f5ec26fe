"""Frozen models over live series."""
