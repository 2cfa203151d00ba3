"""Training-data operators: deduplication, filtering, decontamination, tokenisation."""
