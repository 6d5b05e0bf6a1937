"""Document-page analytics as DataFrame operators."""
