"""plans of the comparison engine."""
