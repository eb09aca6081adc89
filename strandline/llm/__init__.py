"""Training-data operators: deduplication, decontamination, mixing, extraction and scoring."""
