"""Training-data operators: deduplication, quality, extraction, packing, archives and exact search."""
