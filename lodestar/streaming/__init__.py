"""Operators over unbounded rows."""
