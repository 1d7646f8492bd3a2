"""Listening-history analytics as PySpark DataFrame operators."""
