"""Partitioning, scheduling, sampling and collating."""
