"""Training-data operators: fingerprints, filters, deduplication, classification, packing and tokenisation."""
