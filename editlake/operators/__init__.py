"""Operators of the pair analytics engine."""
