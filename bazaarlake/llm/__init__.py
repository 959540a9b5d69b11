"""Training-data operators: packing, toxicity, tokens, deduplication, search, language, chat."""
