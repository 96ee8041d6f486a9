"""Listing-quality checks, verdicts, scores and analytics as Spark DataFrame jobs."""
