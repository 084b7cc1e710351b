"""plans of the palette engine."""
