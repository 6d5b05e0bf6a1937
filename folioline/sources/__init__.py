"""Readers and writers of the record tables, and the small lookup tables."""
