"""Graph and table operators."""
