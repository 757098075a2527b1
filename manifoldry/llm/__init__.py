"""Training-data pipeline operators: deduplication, filtering, tokenisation, packing and sharding."""
