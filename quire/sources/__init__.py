"""Sources of the container engine."""
