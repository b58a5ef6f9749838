"""Retrieval pipelines over text corpora as plain Spark DataFrame queries."""
