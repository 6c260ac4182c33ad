"""Training-data operators: scans, deduplication, tokenising, scoring and sharding of text corpora."""
