"""Training-data operators: deduplication, classifiers, decontamination, archives and mixing."""
