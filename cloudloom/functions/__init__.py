"""Attribute aliases, predicates, metrics and lattice expressions."""
