"""Training-data operators: packing, dedup, language, quality, privacy, mixing and vector search."""
