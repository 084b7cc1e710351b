"""sources of the palette engine."""
