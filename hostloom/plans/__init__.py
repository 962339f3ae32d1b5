"""Registered queries, their oracle SQL and the stand-in inputs both read."""
