"""Fixed compositions of operators."""
