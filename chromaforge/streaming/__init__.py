"""streaming of the palette engine."""
