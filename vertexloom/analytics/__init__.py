"""Whole-graph and whole-table analytics."""
