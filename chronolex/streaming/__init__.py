"""Extension: unigram counts of a stream."""
