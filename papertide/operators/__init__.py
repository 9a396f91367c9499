"""Relational operators that several plans share."""
