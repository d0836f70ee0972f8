"""Training-data operators: deduplication, scoring, packing, encoding, sharding, media and quality."""
