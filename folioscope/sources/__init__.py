"""sources of the comparison engine."""
