"""Functions of the container engine."""
