"""Training-data operators: filters, deduplication, privacy, tokenising and packing of text tables."""
