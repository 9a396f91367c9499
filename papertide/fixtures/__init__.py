"""Writers of small files in the six formats, for queries and tests."""
