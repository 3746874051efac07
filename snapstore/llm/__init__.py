"""Training-data operators: de-duplication, formatting, decontamination, scoring, tokens, packing."""
