"""Streaming of the matching engine."""
