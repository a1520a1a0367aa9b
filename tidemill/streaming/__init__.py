"""Streams of key-value and row changes applied to tables; the dialect itself has no streaming statements."""
