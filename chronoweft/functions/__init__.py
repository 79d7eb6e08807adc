"""Row-level column expressions."""
