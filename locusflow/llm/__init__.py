"""Training-data operators: mixing, filtering, deduplication, packing, archives, scoring."""
