"""Relational, spatial, graph and statistical operators."""
