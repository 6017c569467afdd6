"""Relational, text, graph, temporal and spatial operators."""
