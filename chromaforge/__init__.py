"""Colour-palette generation and image quantisation as Spark DataFrame jobs."""
