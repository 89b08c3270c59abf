"""Streaming of the container engine."""
