"""Training-data pipeline operators: tokens, packing, search, near-duplicates, quality, privacy."""
