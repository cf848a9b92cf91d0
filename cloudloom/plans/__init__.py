"""Pipelines of stages and the registry of queries."""
