"""Training-data operators: quality, secrets, search, tokens, mixing, filters, dedup, language."""
