"""Exact subword-token analytics as Spark columns."""
