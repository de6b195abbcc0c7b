"""Civic report analytics as Spark DataFrame operators and pipelines."""
