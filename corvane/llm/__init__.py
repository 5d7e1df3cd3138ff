"""Training-data operators: deduplication, language, mixing, tokenising, licences, quality, chat and vector search."""
