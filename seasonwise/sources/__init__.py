"""Readers for the input files and request tables."""
