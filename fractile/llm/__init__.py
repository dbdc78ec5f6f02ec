"""Training-data operators: packing, deduplication, mixing, scans, search, extraction."""
