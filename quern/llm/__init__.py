"""Training-data operators: language id, sketches, BPE, toxicity, mixing, near-dedup, LM scoring, line dedup, ANN, WARC."""
