"""Geometric maximum coverage on Spark."""
