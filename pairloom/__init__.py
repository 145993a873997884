"""Paired-text corpus analytics, written for Spark's DataFrame API."""
