"""Decoders of opaque bytes, as plain Python functions without Spark."""
