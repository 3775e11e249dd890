"""Samples, operator graphs and their ingestion."""
