"""Training-data operators: extraction, deduplication, filtering, tokenising and scoring of documents."""
