"""Training-data operators: deduplication, packing, filtering, search and language-model scoring."""
