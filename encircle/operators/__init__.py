"""Joins, aggregates, samples and report operators."""
