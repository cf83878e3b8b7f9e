"""Declarative feature frames on Spark."""
