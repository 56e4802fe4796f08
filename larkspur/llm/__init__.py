"""Training-data operators: filters, deduplication, fingerprints, archives, classifiers, mixing."""
