"""Training-data operators: language, toxicity, near copies, packing, media, tokens, fingerprints, private data, secrets."""
