"""Training-data operators: near-duplicates, mixing, token counts, decontamination, quality, secrets and chat."""
