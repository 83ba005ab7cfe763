"""Training-data operators: formatting, filtering, deduplication, mixing, packing and archives of text corpora."""
