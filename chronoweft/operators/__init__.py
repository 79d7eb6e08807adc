"""DataFrame operators keyed by series."""
