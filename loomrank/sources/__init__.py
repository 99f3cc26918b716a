"""Sources of the matching engine."""
