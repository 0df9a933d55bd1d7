"""Training-data operators: near-dedup, tokens, classifiers, fingerprints, packing."""
