"""Readers that yield graph, line, span and change tables."""
