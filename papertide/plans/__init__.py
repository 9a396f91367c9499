"""DataFrame plans from typed rows to text."""
