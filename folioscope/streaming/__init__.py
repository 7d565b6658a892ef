"""streaming of the comparison engine."""
