"""Operators over role frames."""
