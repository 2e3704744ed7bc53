"""Spark jobs for exam data: paper extraction, key matching, scoring and attempt events."""
