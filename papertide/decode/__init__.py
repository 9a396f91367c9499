"""Byte decoders: containers and records to typed rows, without Spark."""
