"""Compositions of operators: acquisition, optimizers, goal models."""
