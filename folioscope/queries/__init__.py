"""Queries of the core operators and their SQL, by topic."""
