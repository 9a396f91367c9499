"""Native column functions."""
