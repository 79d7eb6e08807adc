"""Registered queries and their SQL checks."""
