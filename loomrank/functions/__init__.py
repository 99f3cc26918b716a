"""Functions of the matching engine."""
