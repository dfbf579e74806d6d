"""Registered queries: every operator on inputs derived from the given tables, with the SQL that
computes the same rows in another engine."""
