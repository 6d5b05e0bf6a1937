"""Queries over the shared test tables and the SQL they are checked with."""
