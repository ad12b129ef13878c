"""Exposure analytics as Spark DataFrame operators."""
