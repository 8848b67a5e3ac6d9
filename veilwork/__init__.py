"""Spark-first engine that finds personal data in large corpora and replaces it."""
