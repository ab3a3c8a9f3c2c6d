"""Training-data operators: filters, dedup, scoring and search over document tables."""
