"""Scalar functions, casts and aggregates by name, each built from Spark's own functions."""
