"""Tidemill: a Spark-first SQL and collections engine."""
