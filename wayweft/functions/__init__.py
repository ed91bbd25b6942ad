"""Functions of the spatial feature graph engine."""
