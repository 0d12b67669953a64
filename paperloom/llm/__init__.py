"""Training-data operators: dedup, mixing, PII, chat, kNN, HTML, ANN, packing, token counts, language ID."""
