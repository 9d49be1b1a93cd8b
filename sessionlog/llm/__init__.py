"""Training-data operators: counting, sharding, deduplication, scoring, search and encoding of texts."""
