"""Training-data operators: packing, search, extraction, scoring, dedup, archives."""
