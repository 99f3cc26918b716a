"""Plans of the matching engine."""
