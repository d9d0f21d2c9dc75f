"""Sources of the pair analytics engine."""
