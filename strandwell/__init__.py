"""Spark-first analytics for ranked evidence retrieval and corpus preparation."""
