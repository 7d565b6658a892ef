"""operators of the comparison engine."""
