"""Training-data operators: scans, near-duplicates, mixing, packing and token output on Spark."""
