"""Training-data operators: filtering, deduplication, sharding, tokenising and archives for text corpora."""
