"""Operators of the matching engine."""
