"""operators of the palette engine."""
