"""functions of the palette engine."""
