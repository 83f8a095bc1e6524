"""gleanspark: code retrieval under a token budget, and its measurement, as DataFrame plans."""
