"""Readers, writers and views over tables."""
