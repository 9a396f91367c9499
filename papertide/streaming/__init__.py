"""Extraction over arriving files."""
