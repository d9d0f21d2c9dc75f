"""Streaming of the pair analytics engine."""
