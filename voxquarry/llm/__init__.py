"""Training-data operators: capture archives, cleaning, deduplication, scoring and mixing."""
