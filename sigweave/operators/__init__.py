"""DataFrame operators of the correlation engine."""
