"""Streaming forms: chained sources and scheduling by count."""
