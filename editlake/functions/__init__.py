"""Functions of the pair analytics engine."""
