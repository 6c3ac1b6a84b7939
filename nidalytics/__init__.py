"""Nest-sensor analytics as Spark DataFrame operators."""
