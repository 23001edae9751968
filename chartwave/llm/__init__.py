"""Operators that a large training-text pipeline needs.  Nothing outside imports this."""
