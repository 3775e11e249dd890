"""Diagnostics and the registered queries."""
