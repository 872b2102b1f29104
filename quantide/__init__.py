"""Spark-first analytics for one-second quote series."""
