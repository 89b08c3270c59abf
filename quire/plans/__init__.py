"""Plans of the container engine."""
