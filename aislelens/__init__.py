"""Retail and quick-commerce analytics written as Spark DataFrame jobs."""
