"""Training-data operators: media columns, LM scoring, dedup, extraction, mixing, counting, scanning."""
