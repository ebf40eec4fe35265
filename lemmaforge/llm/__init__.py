"""Training-data operators: sharding, search, packing, dedup, PII, tokenization."""
