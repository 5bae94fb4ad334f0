"""Training-data operators: mixing, tokens, near-duplicates, language, extraction, search, packing."""
