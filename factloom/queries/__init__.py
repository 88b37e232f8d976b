"""Queries over the given tables, each with the SQL that computes the same rows."""
