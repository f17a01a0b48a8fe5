"""Training-data operators: packing, quality, tokens, extraction, mixing and de-duplication."""
