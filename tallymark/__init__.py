"""Spark jobs that verify label readings against filed applications."""
