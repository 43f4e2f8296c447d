"""Training-data operators: deduplication, quality, packing, sharding, mixing and chat rendering over document tables."""
