"""Quern: resource analytics as plain Spark DataFrame functions."""
