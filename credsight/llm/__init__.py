"""Training-data operators: dedup, tokenizing, quality, mixing, scans, chat formatting."""
