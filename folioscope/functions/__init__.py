"""functions of the comparison engine."""
