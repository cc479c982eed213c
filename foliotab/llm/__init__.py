"""Training-data operators: quality, near copies, mixing, sharding, language, packing, toxicity, secrets, vectors, HTML."""
