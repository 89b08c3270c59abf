"""Operators of the container engine."""
