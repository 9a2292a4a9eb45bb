"""Explainable multi-objective analysis of tables, as DataFrame, SQL and Structured Streaming queries."""
