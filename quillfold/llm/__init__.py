"""Training-data operators: filtering, deduplication, search, mixing, packing and tokenisation."""
